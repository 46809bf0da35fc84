"""Operator 3: a quality classifier from positive and unlabelled documents.

The trusted positives are documents labelled good; everything else the classifier sees is unlabelled web text. It
minimises the non-negative unbiased risk  pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)])  with the logistic loss
l and a small network g over features of whole texts. The class prior pi is estimated too: no set of texts can hold a
smaller share of the unlabelled ones than pi times its share of the positives, so pi is at most the least such ratio.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lobspark.llm.common import NOT_SPACE, bucketed, gram_hash, prefix_hash, span_hash, table, text_bytes, text_chunks, word_spans

#: The most positives, and the most unlabelled documents, that a model is fitted on.
SAMPLE = 10_000


def _class(values) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


CLASSES = [
    _class(range(0x41, 0x5B)),
    _class(range(0x61, 0x7B)),
    _class(range(0x30, 0x3A)),
    _class(b"#*$%&<>^~=@_\\{}[]"),
    _class(b"|"),
    _class(b"!?"),
    _class(b"."),
    _class(b",;:"),
    _class(b"\n"),
    _class(range(0x80, 0x100)),
]


def repeats(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which values have occurred before in their document."""
    order = np.lexsort((key, doc))
    out = np.zeros(len(key), bool)
    out[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    return out


def features(column: pa.Array) -> np.ndarray:
    """One row of numbers for each whole text: shares of kinds of characters, words and repetitions. A null is empty."""
    data, offsets = text_bytes(column)
    n_docs = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets, NOT_SPACE)
    size = np.diff(offsets).astype(float)
    words = np.diff(first).astype(float)
    per_word, per_byte = 1 / np.maximum(words, 1), 1 / np.maximum(size, 1)
    count = [np.diff(np.concatenate([[0], np.cumsum(c[data])])[offsets]).astype(float) for c in CLASSES]
    upper, lower, digit, symbol, pipe, loud, stop, comma, line, wide = count
    prefix = prefix_hash(data)
    h = span_hash(prefix, starts, ends)
    doc = np.searchsorted(first, np.arange(len(starts)), side="right") - 1

    def share(flag: np.ndarray, of: np.ndarray, total: np.ndarray) -> np.ndarray:
        return np.bincount(of[flag], minlength=n_docs) / np.maximum(total, 1)

    g = gram_hash(h, 3)
    g_doc = doc[: len(g)]
    whole = np.arange(len(g)) + 3 <= first[g_doc + 1] if len(g) else np.zeros(0, bool)
    again = share(repeats(g[whole], g_doc[whole]), g_doc[whole], words - 2)
    same = share(repeats(h, doc), doc, words)
    cut = np.union1d(offsets, np.flatnonzero(data == 0x0A) + 1)
    a, b = cut[:-1], cut[1:]
    l_doc = np.searchsorted(offsets, a, side="right") - 1
    b = b - (data[np.maximum(b - 1, 0)] == 0x0A) if len(b) else b
    long = b - a > 1
    lines = np.bincount(l_doc[long], minlength=n_docs)
    line_again = share(repeats(span_hash(prefix, a[long], b[long]), l_doc[long]), l_doc[long], lines)
    ends_odd = share((CLASSES[3] | CLASSES[4] | CLASSES[5])[data[ends - 1]] if len(ends) else np.zeros(0, bool), doc, words)
    caps = share(CLASSES[0][data[starts]] if len(starts) else np.zeros(0, bool), doc, words)
    length = (ends - starts).astype(float)
    mean = np.bincount(doc, length, n_docs) * per_word
    spread = np.sqrt(np.maximum(np.bincount(doc, length**2, n_docs) * per_word - mean**2, 0))
    letters = np.maximum(upper + lower + wide, 1)
    columns = [
        upper / letters,
        wide / letters,
        digit * per_byte,
        symbol * per_word,
        pipe * per_word,
        loud * per_word,
        stop * per_word,
        comma * per_word,
        line * per_word,
        again,
        same,
        line_again,
        ends_odd,
        caps,
        mean / 10,
        spread / 10,
        np.log1p(words) / 8,
        np.log1p(lines) / 4,
        (words == 0).astype(float),
    ]
    return np.minimum(np.stack(columns, 1), 10)


class Network:
    """One hidden layer; fitted by Adam on the non-negative risk."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, hidden: int, rng: np.random.Generator):
        self.mean, self.scale = mean, scale
        d = len(mean)
        self.p = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]

    def _hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1])

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self._hidden(self.scaled(x)) @ self.p[2] + self.p[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -35, 35)))

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, rng: np.random.Generator, steps: int = 900, batch: int = 512, rate: float = 0.01, decay: float = 1e-4) -> None:
        xp, xu = self.scaled(positive), self.scaled(unlabelled)
        m, v = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p]
        for t in range(1, steps + 1):
            p, u = xp[rng.integers(0, len(xp), batch)], xu[rng.integers(0, len(xu), batch)]
            x = np.concatenate([p, u])
            h = self._hidden(x)
            g = h @ self.p[2] + self.p[3][0]
            s = 1 / (1 + np.exp(-np.clip(g, -35, 35)))
            sp, su = s[:batch], s[batch:]
            negative = (np.logaddexp(0, g[batch:]).mean()) - prior * np.logaddexp(0, g[:batch]).mean()
            if negative >= 0:
                dg = np.concatenate([prior * (sp - 1) - prior * sp, su]) / batch
            else:  # the estimate of the negatives' risk fell below zero: step back on it
                dg = np.concatenate([prior * sp, -su]) / batch
            dh = np.outer(dg, self.p[2]) * (1 - h**2)
            grads = [x.T @ dh + decay * self.p[0], dh.sum(0), h.T @ dg + decay * self.p[2], np.array([dg.sum()])]
            step = rate * min(1.0, 2 * (1 - t / (steps + 1)))
            for k, grad in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                self.p[k] = self.p[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)


def thresholds(positive: np.ndarray, least: float = 0.5) -> np.ndarray:
    """Scores that ``least`` of the positives or more reach, rising."""
    return np.quantile(positive, np.linspace(0, 1 - least, 200))


def reached(scores: np.ndarray, t: np.ndarray) -> np.ndarray:
    """How many scores reach each of the thresholds."""
    return len(scores) - np.searchsorted(np.sort(scores), t, side="left")


def class_prior(positive: np.ndarray, n_reached: np.ndarray, n: int, t: np.ndarray) -> float:
    """The least ratio of the unlabelled texts' share to the positives' over the sets {score >= t}, each share with a
    margin for its sampling error. n_reached: how many of the ``n`` unlabelled texts reach each threshold."""
    p, u = reached(positive, t) / len(positive), n_reached / n
    margin = 2.0 / np.sqrt(n) * np.sqrt(u * (1 - u)) + 2.0 / np.sqrt(len(positive)) * np.sqrt(p * (1 - p))
    return float(np.clip(((u + margin) / p).min(), 0.05, 0.99))


def fitted(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 1) -> Network:
    both = np.concatenate([positive, unlabelled])
    rng = np.random.Generator(np.random.PCG64(seed))
    net = Network(np.median(both, 0), both.std(0) + 1e-3, 24, rng)
    net.fit(positive, unlabelled, prior, rng)
    return net


def fit(positive: np.ndarray, unlabelled: np.ndarray, everywhere: Callable[[Network, np.ndarray], tuple[np.ndarray, int]]) -> tuple[Network, float]:
    """The classifier and the class prior it was fitted with. A first run's scores of the sample give a prior for the
    second run, whose scores of all unlabelled documents give the last one. everywhere: for a network and thresholds,
    how many of these documents reach each, and their number."""
    prior = 0.7
    for everything in (False, True):
        net = fitted(positive, unlabelled, prior)
        scores = net.score(positive)
        t = thresholds(scores)
        n_reached, n = everywhere(net, t) if everything else (reached(net.score(unlabelled), t), len(unlabelled))
        prior = class_prior(scores, n_reached, n, t)
    return fitted(positive, unlabelled, prior), prior


def feature_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            x = features(chunk.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64()))], ("x",))

    return docs.select("text").mapInArrow(run, "x array<double>")


def _lowest(rows: DataFrame, n: int) -> DataFrame:
    """``n`` of the doc_ids at most, the same ones at every run: those with the smallest hash."""
    return rows.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(n)


def reaching(docs: DataFrame, net: Network, t: np.ndarray) -> tuple[np.ndarray, int]:
    """How many of all docs reach each threshold, and their number; each batch sends sums only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            n = reached(net.score(features(chunk.column("text"))), t)
            yield pa.RecordBatch.from_arrays([pa.array([n.tolist()], pa.list_(pa.int64())), pa.array([chunk.num_rows], pa.int64())], ("n", "all"))

    each = docs.select("text").mapInArrow(run, "n array<long>, all long")
    row = each.agg(F.array(*(F.coalesce(F.sum(F.col("n")[i]), F.lit(0)) for i in range(len(t)))).alias("n"), F.sum("all").alias("all")).first()
    return np.array(row["n"], float), row["all"]


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Network, float] | None:
    """Fits on at most ``sample`` documents labelled good and ``sample`` documents as unlabelled ones (their labels, if
    any, are not looked at), all from the folds to learn from; the class prior is estimated over all of these folds. Of
    rows that repeat a doc_id the smallest text counts. Without a positive there is no model (None)."""
    good = labels.where((F.col("quality") == 1) & (bucketed(F.col("doc_id"), 3) != 1))
    web = docs.where(bucketed(F.col("doc_id"), 3) != 1)
    rows = []
    for ids in (_lowest(good, sample), _lowest(web, sample)):
        chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")  # no more than ``sample`` ids
        chosen = chosen.groupBy("doc_id").agg(F.min("text").alias("text"))
        rows.append(np.array([r[0] for r in feature_rows(chosen).collect()], float))
    if not len(rows[0]) or not len(rows[1]):
        return None
    return fit(*rows, lambda net, t: reaching(web, net, t))


def scored(docs: DataFrame, model: tuple[Network, float] | None, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` (in place of one of that name); 0.5 for all where there is no model."""
    fields = [f for f in docs.schema.fields if f.name != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            s = model[0].score(features(chunk.column("text"))) if model else np.full(chunk.num_rows, 0.5)
            columns = [chunk.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(s, pa.float64())], (*(f.name for f in fields), name))

    return docs.select(*(f"`{f.name}`" for f in fields)).mapInArrow(run, T.StructType([*fields, T.StructField(name, T.DoubleType())]))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = scored(docs.select("doc_id", "text"), learned(docs, labels))
    return out.select("doc_id", F.coalesce(bucketed(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
