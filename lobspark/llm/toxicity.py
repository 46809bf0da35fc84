"""Operator 5: toxicity by a weighted finite-state grammar over clauses.

A lexical transducer reads words and writes symbols: insult (with a weight learned from the labelled documents), harm,
intent, target, negation, report or other; a word may have several. Five transducers are composed, each reading what the
one before it writes: threats turns a harm after an intent and a target into a threat, targets an insult after a target
into one that is aimed, negation and reported speech weaken what they reach, and insults gives what is left its weight.
The composition is one machine, whose state holds what is pending in each. Matched clauses are scored, and a logistic
model fitted on the same labelled documents turns a document's clauses into a probability.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lobspark.llm.common import ALNUM, LOWER, bucketed, checkpointed, prefix_hash, span_hash, table, text_bytes, text_chunks, word_spans

#: The most labelled documents that lexicon and calibration are learned from, and the most lexicon entries.
SAMPLE, ENTRIES = 12_000, 4_000
#: Lengths in bytes of the word beginnings that may become entries; 0 stands for whole words.
STEMS = (4, 5, 6, 7, 8)

OTHER, INSULT, HARM, INTENT, TARGET, NEGATION, REPORT, AIMED, THREAT = range(9)
#: Function words of the grammar, in the four languages of the texts. Words are runs of letters and digits, so the t of a
#: contracted not and the n of a contracted ne are words.
GRAMMAR = {
    HARM: "kill kills killed killing hurt hurts hurting beat beats beaten beating destroy destroys destroyed destroying shoot shoots shooting shot stab stabs stabbed stabbing "
    "töten tötet tötete getötet schlagen schlägt schlug geschlagen zerstören zerstört verletzen verletzt tuer tue tues tué tuerai frapper frappe frappes frappé détruire détruit blesser blesse blessé "
    "matar mato mata matas matado mataré golpear golpea golpeado destruir destruye destruido herir hiere herido",
    INTENT: "will gonna shall going werde werden wirst vais allons voy vamos",
    TARGET: "you your youre he she they them ihr euch dich du sie vous toi ils elles tú ustedes vosotros ellos",
    NEGATION: "not t no never isnt arent dont wont cant isn’t aren’t ain’t don’t won’t can’t n nicht kein keine nie pas jamais aucun nunca jamás ningún",
    REPORT: "said says called claimed wrote quoted sagte schrieb nannte dit écrit appelé dijo escribió llamó",
}

#: Weights of a match: an insult, one that is aimed, a threat; and the factors for negation (which reaches this many
#: symbols) and reported speech.
WEIGHTS = {INSULT: 1.0, AIMED: 1.5, THREAT: 3.0}
NEGATED, REACH, REPORTED = 0.3, 3, 0.5


@dataclass(frozen=True)
class Transducer:
    """step: (state, symbol read) to (next state, symbol written, weight); it begins a clause in state 0."""

    name: str
    step: Callable[[int, int], tuple[int, int, float]]


#: The state is a set of bits: an intent has been read, a target has been read.
THREATS = Transducer("threats", lambda s, c: (s | (c == INTENT) | (c == TARGET) << 1, (THREAT if s == 3 else OTHER) if c == HARM else c, 1.0))
TARGETS = Transducer("targets", lambda s, c: (int(s or c == TARGET), AIMED if s and c == INSULT else c, 1.0))
#: The state is how many symbols the negation still reaches.
NEGATIONS = Transducer("negation", lambda s, c: (REACH if c == NEGATION else max(0, s - 1), c, NEGATED if s and c in WEIGHTS else 1.0))
REPORTS = Transducer("reported speech", lambda s, c: (int(s or c == REPORT), c, REPORTED if s and c in WEIGHTS else 1.0))
INSULTS = Transducer("insults", lambda s, c: (0, c if c in WEIGHTS else OTHER, WEIGHTS.get(c, 1.0)))
GRAMMAR_ORDER = (THREATS, TARGETS, NEGATIONS, REPORTS, INSULTS)


class Machine:
    """The composition of transducers: each reads what the one before it writes, and weights multiply.

    States are tuples of theirs, found from the start. ``next`` and ``factor`` are tables by state and symbol; a factor
    is 0 where the last one writes OTHER, which is no match.
    """

    def __init__(self, *parts: Transducer):
        start = (0,) * len(parts)
        self.states, todo = {start: 0}, [start]
        self.next: list[list[int]] = []
        self.factor: list[list[float]] = []
        while todo:
            now = todo.pop(0)
            after, weights = [], []
            for symbol in range(REPORT + 1):
                then, written, weight = [], symbol, 1.0
                for part, state in zip(parts, now, strict=True):
                    state, written, w = part.step(state, written)
                    then.append(state)
                    weight *= w
                key = tuple(then)
                if key not in self.states:
                    self.states[key] = len(self.states)
                    todo.append(key)
                after.append(self.states[key])
                weights.append(weight if written != OTHER else 0.0)
            self.next.append(after)
            self.factor.append(weights)


MACHINE = Machine(*GRAMMAR_ORDER)
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in ".,;:!?\n()\"|"]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes of texts with A-Z in lower case, and so the capitals of Latin-1, whose UTF-8 has C3 and then 80 to 9E but for 97."""
    low = LOWER[data]
    if len(low):
        low[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)] += 0x20
    return low


class Words:
    """The words of some texts: their hashes, their clauses, and hashes of their beginnings."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = text_bytes(column)
        low = lowered(self.data)
        self.prefix = prefix_hash(low)
        self.starts, self.ends, self.first = word_spans(low, self.offsets, ALNUM)
        self.h = span_hash(self.prefix, self.starts, self.ends)
        self.doc = np.searchsorted(self.first, np.arange(len(self.starts)), side="right") - 1

    def clauses(self) -> np.ndarray:
        """A number for each word's clause; it never goes from one text into the next."""
        marks = np.concatenate([[0], np.cumsum(_MARKS[self.data])])
        return marks[self.starts] + self.doc  # both never fall

    def stem(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words are longer than n bytes, and the hashes of their first n (tagged with n)."""
        at = np.flatnonzero(self.ends - self.starts > n)
        return at, span_hash(self.prefix, self.starts[at], self.starts[at] + n) ^ np.uint64(n)


def _member(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the values that are wanted (sorted), and their places there."""
    if not len(wanted) or not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
    at = np.flatnonzero(wanted[k] == values)
    return at, k[at]


class Grammar:
    """The lexical transducer with learned insult weights, the machine, and the calibration."""

    def __init__(self, entries: dict[int, float], machine: Machine = MACHINE):
        self.machine = machine
        order = sorted(entries)
        self.keys = np.array(order, np.uint64)
        self.weights = np.array([entries[k] for k in order])
        listed = {}
        for symbol, words in GRAMMAR.items():
            w = Words(pa.array(words.split()))
            listed |= {int(x): symbol for x in w.h}
        self.listed = np.array(sorted(listed), np.uint64)
        self.symbols = np.array([listed[int(x)] for x in self.listed], np.int8)
        self.mean, self.scale, self.beta = np.zeros(6), np.ones(6), np.zeros(7)

    def read(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Each word's function symbol, and its weight as an insult (0: none): that of its longest entry, the whole word
        or a beginning. A word may be both."""
        symbol, weight = np.zeros(len(words.h), np.int8), np.zeros(len(words.h))
        for n in STEMS:
            of, h = words.stem(n)
            at, k = _member(h, self.keys)
            weight[of[at]] = self.weights[k]
        at, k = _member(words.h, self.keys)
        weight[at] = self.weights[k]
        at, k = _member(words.h, self.listed)
        symbol[at] = self.symbols[k]
        return symbol, weight

    def clause_scores(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each matched clause: its text, its score, its number of matches. The machine begins each clause anew."""
        symbol, weight = self.read(words)
        clause = words.clauses()
        live = np.unique(clause[(weight > 0) | (symbol == HARM)])  # the others can't match
        first, last = np.searchsorted(clause, live), np.searchsorted(clause, live, side="right")
        factor, move = self.machine.factor, self.machine.next
        doc, score, many = [], [], []
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            state, total, n = 0, 0.0, 0
            for s, w in zip(symbol[a:b].tolist(), weight[a:b].tolist(), strict=True):
                if s or not w:
                    if f := factor[state][s]:
                        total += f
                        n += 1
                    state = move[state][s]
                if w:
                    if f := factor[state][INSULT]:
                        total += f * w
                        n += 1
                    state = move[state][INSULT]
            if n:
                doc.append(int(words.doc[a]))
                score.append(total)
                many.append(n)
        return np.array(doc, np.int64), np.array(score), np.array(many, np.int64)

    def features(self, column: pa.Array) -> np.ndarray:
        words = Words(column)
        doc, score, many = self.clause_scores(words)
        n_docs = len(words.first) - 1
        n_words = np.maximum(np.diff(words.first), 1).astype(float)
        total, matches, clauses = (np.bincount(doc, v, n_docs) for v in (score, many, np.ones(len(doc))))
        best = np.zeros(n_docs)
        np.maximum.at(best, doc, score)
        return np.stack([np.log1p(total), np.log1p(best), np.log1p(matches), np.log1p(clauses), np.log1p(100 * total / n_words), np.log1p(n_words)], 1)

    def score(self, column: pa.Array) -> np.ndarray:
        x = (self.features(column) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.beta[1:] + self.beta[0], -35, 35)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> None:
        """Logistic regression by Newton's method."""
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        a = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        beta = np.zeros(a.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ beta, -35, 35)))
            pull = ridge * np.r_[0, beta[1:]]
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(beta)), a.T @ (y - p) - pull)
            beta = beta + step
            if np.abs(step).max() < 1e-8:
                break
        self.beta = beta


def entry_counts(docs: DataFrame) -> DataFrame:
    """(key, half, toxic documents, other documents) of whole words and beginnings; docs: text, toxic, half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
        for chunk in text_chunks(batches):
            words = Words(chunk.column("text"))
            kind = chunk.column("half").to_numpy() * 2 + chunk.column("toxic").to_numpy()
            for at, h in ((np.arange(len(words.h)), words.h), *(words.stem(n) for n in STEMS)):
                order = np.lexsort((h, words.doc[at]))
                k, d = h[order], words.doc[at][order]
                new = np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])]) if len(k) else np.zeros(0, bool)
                for x, c in zip(k[new].tolist(), kind[d[new]].tolist(), strict=True):
                    total[x][c] += 1
        keys = np.array(list(total), np.uint64).view(np.int64)
        counts = np.array(list(total.values()), np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(counts[:, i].copy()) for i in range(4))], ("key", "a0", "a1", "b0", "b1"))

    counted = docs.mapInArrow(run, "key long, a0 long, a1 long, b0 long, b1 long")
    return counted.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("a0", "a1", "b0", "b1")))


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, entries: int = ENTRIES, machine: Machine = MACHINE) -> Grammar | None:
    """Learns from at most ``sample`` labelled rows of the folds to learn from (those whose ids have the smallest hashes).

    The lexicon of one half's documents is calibrated on the other half, and the final lexicon is of both. An entry
    needs toxic documents far out of proportion; its weight is its log odds. Of rows that repeat a doc_id the smallest
    text counts. Without both labels there is no model. machine: the composed grammar, for ablations.
    """
    rows = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(bucketed(F.col("doc_id"), 5) != 0)
    chosen = rows.groupBy("doc_id").agg(F.max(F.col("toxic").cast("long")).alias("toxic")).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample)
    chosen = chosen.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(2)))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # no more than ``sample`` ids
    texts = checkpointed(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"), F.first("half").alias("half")).select("text", "toxic", "half"))
    n = {(r["half"], r["toxic"]): r["n"] for r in texts.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = [n.get((0, 1), 0), n.get((1, 1), 0)], [n.get((0, 0), 0), n.get((1, 0), 0)]
    if not sum(toxic) or not sum(clean):
        return None
    odds = lambda t, c, nt, nc: F.log((F.col(t) + 0.1) / (nt + 0.2)) - F.log((F.col(c) + 0.5) / (nc + 1.0))
    counts = entry_counts(texts).withColumns({"t": F.col("a1") + F.col("b1"), "c": F.col("a0") + F.col("b0")})
    found = counts.withColumn("w", odds("t", "c", sum(toxic), sum(clean))).where("t >= 4 AND w > 1.5")
    best = found.orderBy(F.desc(F.col("w") * F.sqrt("t")), "key").limit(entries).collect()
    final, halves = {}, ({}, {})
    for r in best:
        key = r["key"] % (1 << 64)
        final[key] = float(r["w"])
        for i, (t, c) in enumerate((("a1", "a0"), ("b1", "b0"))):
            w = np.log((r[t] + 0.1) / (toxic[i] + 0.2)) - np.log((r[c] + 0.5) / (clean[i] + 1.0))
            if r[t] >= 2 and w > 1.5:
                halves[i][key] = float(w)
    parts = [Grammar(h, machine) for h in halves]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            half = chunk.column("half").to_numpy()
            both = [g.features(chunk.column("text")) for g in parts]
            x = np.where((half == 0)[:, None], both[1], both[0])
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), chunk.column("toxic")], ("x", "toxic"))

    got = texts.mapInArrow(run, "x array<double>, toxic long").collect()
    model = Grammar(final, machine)
    model.calibrate(np.array([r["x"] for r in got], float), np.array([r["toxic"] for r in got], float))
    return model


def scored(docs: DataFrame, model: Grammar | None) -> DataFrame:
    """(doc_id, score): 0 to 1, higher for toxic; nulls and empty texts get what a text without matches gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            s = model.score(chunk.column("text")) if model else np.zeros(chunk.num_rows)
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(s, pa.float64())], ("doc_id", "score"))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = scored(docs, learned(docs, labels))
    held = F.coalesce(bucketed(F.col("doc_id"), 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
