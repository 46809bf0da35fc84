"""Operator 8: quality rules with a linear-chain conditional random field over a document's lines.

Each line gets features of its own text and of its place; the field scores a labelling of all lines by these features
and by the labels of neighbouring lines, and Viterbi decoding finds the best labelling. The share of words in lines
labelled content decides whether a document is kept.

No line labels exist, so training takes weak ones that differ within a document. A line is evidently boilerplate if it
repeats an earlier line of its document, stands between many different neighbours in the whole corpus, is mostly
symbols or mostly repeats itself. The other lines of documents labelled good are content. In documents labelled bad the
other lines are left open, and training sums over their labels; only where a bad document has no evident line at all
are all of them boilerplate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lobspark.llm.common import NOT_SPACE, mixed, prefix_hash, same_spans, span_hash, table, text_bytes, text_chunks, word_spans

#: The most labelled documents that the field is trained on.
SAMPLE = 4000
#: Different pairs of neighbours, over all documents, between which a line of the sample stands before it counts as
#: boilerplate. Copies of a document give its lines one pair only.
SHARED = 4
#: A training sequence's most lines, and the most sequences of a document (evenly spaced).
STRETCH, STRETCHES = 64, 2

BOILERPLATE, CONTENT, OPEN = 0, 1, 2


def _class(values) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


SYMBOLS = _class(b"#*$%&|<>")
KINDS = [_class(range(0x41, 0x5B)), _class([*range(0x61, 0x7B), *range(0x80, 0x100)]), _class(range(0x30, 0x3A)), _class(b"#*$%&<>^~=@_\\{}[]"), _class(b"|"), _class(b"!?"), _class(b".,;:")]


def twice(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values have occurred before in their document, and which occur twice or more in it."""
    order = np.lexsort((key, doc))
    again = np.zeros(len(key), bool)
    again[1:] = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    many = again.copy()
    many[:-1] |= again[1:]
    before, any_ = np.zeros(len(key), bool), np.zeros(len(key), bool)
    before[order], any_[order] = again, many
    return before, any_


def exact_kinds(data: np.ndarray, prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each span of bytes, the same for equal ones only: by hash, and compared byte by byte with the first
    span of that hash. Should hashes of different spans agree, all are numbered by their bytes."""
    _, first, kind = np.unique(span_hash(prefix, a, b), return_index=True, return_inverse=True)
    if same_spans(data, a, b, a[first[kind]], b[first[kind]]).all():
        return kind
    number: dict[bytes, int] = {}
    return np.array([number.setdefault(data[x:y].tobytes(), len(number)) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)


def triples(kind: np.ndarray) -> np.ndarray:
    """A number for each run of three of the values, the same for equal runs only."""
    if len(kind) < 3:
        return kind[:0]
    many = int(kind.max()) + 1
    if many < 1 << 21:
        return (kind[:-2] * many + kind[1:-1]) * many + kind[2:]
    pair = np.unique(kind[:-1] * many + kind[1:], return_inverse=True)[1]
    return pair[:-1] * many + kind[2:]


class Lines:
    """Some texts with their words and their lines that have a word."""

    @classmethod
    def plain(cls, column: pa.Array) -> Lines:
        """Without what only counts and features need."""
        return cls(column, counted=False)

    def __init__(self, column: pa.Array, counted: bool = True):
        self.data, self.offsets = text_bytes(column)
        self.n_docs = len(self.offsets) - 1
        self.starts, self.ends, self.first = word_spans(self.data, self.offsets, NOT_SPACE)
        self.prefix = prefix_hash(self.data)
        cut = np.union1d(self.offsets, np.flatnonzero(self.data == 0x0A) + 1)
        a, b = cut[:-1], cut[1:] - (self.data[cut[1:] - 1] == 0x0A) if len(self.data) else cut[1:]
        f = np.searchsorted(self.starts, a)
        n = np.searchsorted(self.starts, b) - f
        real = n > 0
        self.a, self.b, self.word, self.n = a[real], b[real], f[real], n[real]
        self.line_doc = np.searchsorted(self.offsets, self.a, side="right") - 1
        self.hash = span_hash(self.prefix, self.a, self.b)
        self.longest = np.bincount(self.line_doc, minlength=self.n_docs)
        if not counted:
            return
        self.doc = np.searchsorted(self.first, np.arange(len(self.starts)), side="right") - 1
        self.before, _ = twice(exact_kinds(self.data, self.prefix, self.a, self.b), self.line_doc)
        g = triples(exact_kinds(self.data, self.prefix, self.starts, self.ends))
        at = np.flatnonzero(np.arange(len(g)) + 3 <= self.first[self.doc[: len(g)] + 1]) if len(g) else np.zeros(0, np.int64)
        _, many = twice(g[at], self.doc[at])
        step = np.zeros(len(self.starts) + 1, np.int64)
        np.add.at(step, at[many], 1)
        np.add.at(step, at[many] + 3, -1)
        self.repeated = np.cumsum(step[:-1]) > 0

    def neighbours(self) -> np.ndarray:
        """A hash of the lines before and after each line, as far as its document has them."""
        h = mixed(self.hash)
        same = self.line_doc[1:] == self.line_doc[:-1]
        out = np.zeros(len(h), np.uint64)
        out[1:] += np.where(same, h[:-1], 0)
        out[:-1] += np.where(same, h[1:] * np.uint64(3), 0)
        return out

    def evident(self, x: np.ndarray) -> np.ndarray:
        """Lines that are boilerplate by themselves; x: their features."""
        return self.before | (x[:, 10] > 0) | ((x[:, 12] > 0.5) & (self.n >= 5))

    def counts(self) -> dict[str, np.ndarray]:
        """The base rules' figures of each whole text."""
        point = (self.data & 0xC0) != 0x80
        total = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[self.offsets])
        words = np.diff(self.first)
        return {
            "n_words": words,
            "word_chars": total(NOT_SPACE[self.data] & point),
            "n_symbols": total(SYMBOLS[self.data]),
            "n_dup_lines": np.bincount(self.line_doc[self.before], minlength=self.n_docs),
            "n_repeat_words": np.bincount(self.doc[self.repeated], minlength=self.n_docs),
        }

    def features(self) -> np.ndarray:
        size = np.maximum(self.b - self.a, 1).astype(float)
        sums = [np.concatenate([[0], np.cumsum(k[self.data])]) for k in KINDS]
        upper, lower, digit, symbol, pipe, loud, stop = ((s[self.b] - s[self.a]).astype(float) for s in sums)
        rep = np.concatenate([[0], np.cumsum(self.repeated)])
        last = self.data[np.maximum(self.b - 1, 0)] if len(self.data) else np.zeros(0, np.uint8)
        place = np.arange(len(self.a)) - (np.cumsum(self.longest) - self.longest)[self.line_doc]
        left = self.longest[self.line_doc] - 1 - place
        n = self.n.astype(float)
        return np.stack(
            [
                np.ones(len(n)),
                np.log1p(n) / 3,
                (n < 5).astype(float),
                upper / np.maximum(upper + lower, 1),
                digit / size,
                symbol / n,
                pipe / n,
                loud / n,
                stop / n,
                np.isin(last, np.frombuffer(b".:;,", np.uint8)).astype(float),
                (symbol + pipe + loud > 0.3 * n).astype(float),
                self.before.astype(float),
                (rep[self.word + self.n] - rep[self.word]) / n,
                size / n / 10,
                (place == 0).astype(float),
                (left == 0).astype(float),
                (self.longest[self.line_doc] == 1).astype(float),
            ],
            1,
        )


@dataclass
class Field:
    """weights: features to the score of content over boilerplate; pair: scores of neighbouring labels (0 boilerplate)."""

    weights: np.ndarray
    pair: np.ndarray
    scale: np.ndarray

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return (x / self.scale) @ self.weights

    def decode(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Viterbi: each line's label in its document's best labelling; all documents advance a line at a time."""
        e = self.emissions(x)
        begin = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        longest = int(lengths.max(initial=0))
        out, back = np.zeros(len(x), np.int8), np.zeros((len(x), 2), np.int8)
        if not longest:
            return out
        live = np.searchsorted(-lengths[order], -np.arange(1, longest + 1), side="right")  # documents with a line t
        best = np.zeros((len(lengths), 2))
        d = order[: live[0]]
        best[d, 1] = e[begin[d]]
        for t in range(1, longest):
            d = order[: live[t]]
            through = best[d][:, :, None] + self.pair[None]
            k = begin[d] + t
            back[k] = through.argmax(1)
            best[d] = through.max(1)
            best[d, 1] += e[k]
        label = best.argmax(1)
        for t in range(longest - 1, -1, -1):
            d = order[: live[t]]
            k = begin[d] + t
            out[k] = label[d]
            if t:
                label[d] = back[k, label[d]]
        return out


class Chains:
    """Sequences of lines laid out by place: first all first lines, the longest sequence's first, then all second ones.

    ``at`` gives for each place in this layout the line; those of place t are ``edge[t]`` to ``edge[t + 1]``, and the
    line before the k-th of them is the k-th of place t - 1. A label's odds are scalars, as there are two labels.
    """

    def __init__(self, lengths: np.ndarray):
        begin = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        live = np.searchsorted(-lengths[order], -np.arange(1, int(lengths.max()) + 1), side="right")
        self.edge = np.concatenate([[0], np.cumsum(live)])
        self.at = np.concatenate([begin[order[:n]] + t for t, n in enumerate(live)])
        self.live = live

    def expected(self, odds: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each line's probability of label 1, and how often each pair of neighbouring labels is expected.

        odds: of label 1 by the emissions, in this layout; step: factors of neighbouring labels.
        """
        edge, live = self.edge, self.live
        forward, backward = odds.copy(), np.ones_like(odds)
        for t in range(1, len(live)):
            before = forward[edge[t - 1] : edge[t - 1] + live[t]]
            forward[edge[t] : edge[t + 1]] *= (step[0, 1] + step[1, 1] * before) / (step[0, 0] + step[1, 0] * before)
        for t in range(len(live) - 1, 0, -1):
            after = odds[edge[t] : edge[t + 1]] * backward[edge[t] : edge[t + 1]]
            backward[edge[t - 1] : edge[t - 1] + live[t]] = (step[1, 0] + step[1, 1] * after) / (step[0, 0] + step[0, 1] * after)
        p = forward * backward
        p /= 1 + p
        left = np.concatenate([forward[edge[t - 1] : edge[t - 1] + live[t]] for t in range(1, len(live))] or [forward[:0]])
        right = (odds * backward)[edge[1] :]
        joint = np.stack([np.full(len(left), step[0, 0]), step[0, 1] * right, step[1, 0] * left, step[1, 1] * left * right])
        return p, (joint / joint.sum(0)).sum(1).reshape(2, 2)


def train(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, steps: int = 400, rate: float = 0.05, ridge: float = 1e-3, still: float = 2e-4) -> Field:
    """Maximises the likelihood of the given labels, summed over those that are OPEN, until the gradient is ``still``.

    The gradient is the difference between two runs of the forward-backward recursions: one held to the labels, one free.
    """
    scale = x.std(0) + 0.05
    chains = Chains(lengths)
    scaled = (x / scale)[chains.at]
    held = np.array([-50.0, 50.0, 0.0])[y[chains.at].astype(np.int64)]
    w, pair = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for t in range(1, steps + 1):
        e, step = np.clip(scaled @ w, -30, 30), np.exp(pair)
        p_held, pairs_held = chains.expected(np.exp(e + held), step)
        p_free, pairs_free = chains.expected(np.exp(e), step)
        grad = np.concatenate([scaled.T @ (p_held - p_free), (pairs_held - pairs_free).ravel()]) / len(x) - ridge * np.concatenate([w, pair.ravel()])
        if np.abs(grad).max() < still:
            break
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        go = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, pair = w + go[:-4], pair + go[-4:].reshape(2, 2)
    return Field(w, pair, scale)


def line_rows(docs: DataFrame) -> DataFrame:
    """(good, bare, x, h, evident) of docs (text, good): a row for each stretch of lines. bare: the whole document has
    no evident line."""
    kinds = {"good": pa.int64(), "bare": pa.bool_(), "x": pa.list_(pa.float32()), "h": pa.list_(pa.int64()), "evident": pa.list_(pa.bool_())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            lines = Lines(chunk.column("text"))
            x = lines.features()
            evident = lines.evident(x)
            first = np.cumsum(lines.longest) - lines.longest
            rows: list[tuple] = []
            for good, a, n in zip(chunk.column("good").to_pylist(), first.tolist(), lines.longest.tolist(), strict=True):
                bare = not evident[a : a + n].any()
                k = -(-n // STRETCH)
                for j in sorted({i * k // min(k, STRETCHES) for i in range(min(k, STRETCHES))}):
                    part = slice(a + j * STRETCH, a + min(n, (j + 1) * STRETCH))
                    rows.append((good, bare, x[part].ravel().tolist(), lines.hash[part].view(np.int64).tolist(), evident[part].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds))

    return docs.select("text", "good").mapInArrow(run, "good long, bare boolean, x array<float>, h array<long>, evident array<boolean>")


def shared_lines(docs: DataFrame, wanted: np.ndarray, least: int = SHARED) -> set[int]:
    """Which of the line hashes ``wanted`` (sorted) stand between ``least`` or more different pairs of neighbours in
    all documents. Each task sends a line's pairs once for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            lines = Lines.plain(chunk.column("text"))
            h = lines.hash.view(np.int64)
            at = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h)
            both = np.unique(np.stack([h[at], lines.neighbours().view(np.int64)[at]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ("h", "near"))

    pairs = docs.select("text").mapInArrow(run, "h long, near long").distinct()
    common = pairs.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return {r["h"] for r in common.select("h").collect()}  # some of ``wanted``


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field | None:
    """Trained on lines of at most ``sample`` / 2 labelled documents of each kind (those whose ids have the smallest
    hashes), of each STRETCHES sequences of STRETCH lines at most. Of rows that repeat a doc_id the smallest text counts.
    None without content and boilerplate."""
    marked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality").cast("long")).alias("good"))
    order = [F.xxhash64("doc_id", F.lit(8)), F.col("doc_id")]
    ids = [marked.where(F.col("good") == g).orderBy(*order).limit(sample // 2) for g in (0, 1)]
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")  # no more than ``sample`` rows
    chosen = chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("good").alias("good"))
    got = [r for r in line_rows(chosen).collect() if len(r["h"])]
    if not got:
        return None
    common = shared_lines(docs, np.unique(np.concatenate([np.array(r["h"], np.int64) for r in got])))
    xs, ys = [], []
    for r in got:
        xs.append(np.array(r["x"], float).reshape(len(r["h"]), -1))
        evident = np.array(r["evident"]) | np.array([h in common for h in r["h"]])
        rest = CONTENT if r["good"] == 1 else BOILERPLATE if r["bare"] and not evident.any() else OPEN
        ys.append(np.where(evident, BOILERPLATE, rest))
    y = np.concatenate(ys)
    if not (y == CONTENT).any() or not (y == BOILERPLATE).any():
        return None
    return train(np.concatenate(xs), y, np.array([len(part) for part in ys]))


def judged(docs: DataFrame, field: Field | None, least_share: float = 0.5, least_words: int = 50, most_repeated: float = 0.5) -> DataFrame:
    """A row for each row of docs: doc_id, the base figures, base_failed, content_share, labels (of the lines with a
    word, 1 for content), kept.

    base_failed: fewer than ``least_words`` words, or a larger share than ``most_repeated`` of them in repeated three-word
    windows. Of the others those are kept whose content lines have ``least_share`` of the words (without a field, all).
    A null or empty text has no words and lines, and a content share of 0.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            lines = Lines(chunk.column("text"))
            base = lines.counts()
            label = field.decode(lines.features(), lines.longest) if field else np.ones(len(lines.n), np.int8)
            content = np.bincount(lines.line_doc, lines.n * label, lines.n_docs)
            n = base["n_words"]
            share = content / np.maximum(n, 1)
            failed = (n < least_words) | (base["n_repeat_words"] > most_repeated * n)
            marks = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lines.longest)]).astype(np.int32)), pa.array(label))
            columns = [chunk.column("doc_id"), *(pa.array(base[k].astype(np.int64)) for k in names), pa.array(failed), pa.array(share), marks, pa.array(~failed & (share >= least_share))]
            yield pa.RecordBatch.from_arrays(columns, ("doc_id", *names, "base_failed", "content_share", "labels", "kept"))

    fields = ", ".join(f"{k} long" for k in names)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {fields}, base_failed boolean, content_share double, labels array<tinyint>, kept boolean")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = judged(docs, learned(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")
