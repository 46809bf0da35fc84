"""Operator 2: benchmark decontamination by a prefix-filtered containment join.

An item is held as its windows of ``window`` words. Containment of a whole window needs all its shingles, so by the
prefix filter's bound a single one suffices to find it: the rarest over all documents. Documents stream past those
rarest shingles; a match gives the only place where its window can stand, which the length and positional bounds
may rule out; what is left is compared word by word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lobspark.llm.common import ALNUM, LOWER, checkpointed, gram_hash, prefix_hash, span_hash, stored, table, text_bytes, text_chunks, word_spans

#: Windows of a block of items; a block's index (some 300 bytes a window) is what every task gets.
BLOCK_WINDOWS = 200_000


class Windows:
    """The distinct windows of some items, by their shingles' hashes. Lives on the driver and in the tasks."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int, shingle: int):
        self.window = window
        data, offsets = text_bytes(pa.array([t for _, t in items], pa.string()))
        data = LOWER[data]
        starts, ends, first = word_spans(data, offsets, ALNUM)
        h = span_hash(prefix_hash(data), starts, ends)
        owners: dict[tuple[bytes, ...], set[str | None]] = defaultdict(set)
        place: dict[tuple[bytes, ...], int] = {}
        for k, (item_id, _) in enumerate(items):
            a, b = int(first[k]), int(first[k + 1])
            words = [data[s:e].tobytes() for s, e in zip(starts[a:b], ends[a:b], strict=True)]
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if words else 0):
                key = tuple(words[i : i + size])
                owners[key].add(None if item_id is None else str(item_id))
                place.setdefault(key, a + i)
        self.words = list(owners)
        self.owners = [owners[w] for w in self.words]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        #: By shingle size: each window's shingle hashes, in order.
        self.shingles: list[tuple[int, np.ndarray]] = []
        for w in self.words:
            k = min(shingle, len(w))
            self.shingles.append((k, gram_hash(h[place[w] : place[w] + len(w)], k)))
        self.grams = {k: np.unique(np.concatenate([g for n, g in self.shingles if n == k])) for k in {n for n, _ in self.shingles}}
        self.postings: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def choose(self, seen: dict[tuple[int, int], int]) -> None:
        """Keep of each window its rarest shingle. seen: occurrences in all documents by (size, hash)."""
        postings = defaultdict(list)
        for w, (k, g) in enumerate(self.shingles):
            o = min(range(len(g)), key=lambda j: (seen.get((k, int(g[j])), 0), int(g[j])))
            postings[k, int(g[o])].append((w, o))
        self.postings = dict(postings)
        self.grams = {k: np.array(sorted(h for n, h in postings if n == k), np.uint64) for k in self.grams}
        self.shingles = []


def found(h: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions of the values that are in ``wanted`` (sorted)."""
    sieve = np.zeros(1 << 20, bool)
    sieve[(wanted & np.uint64(0xFFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(sieve[(h & np.uint64(0xFFFFF)).astype(np.int64)])
    k = np.minimum(np.searchsorted(wanted, h[at]), len(wanted) - 1)
    return at[wanted[k] == h[at]]


def _words(chunk: pa.RecordBatch):
    data, offsets = text_bytes(chunk.column("text"))
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, ALNUM)
    return data, starts, ends, first, span_hash(prefix_hash(data), starts, ends)


def _matches(h: np.ndarray, first: np.ndarray, index: Windows) -> Iterator[tuple[int, np.ndarray]]:
    """For each shingle size, the hashes at all words and where a wanted one stands wholly within a document."""
    for k, wanted in index.grams.items():
        g = gram_hash(h, k)
        if len(g) and len(wanted):
            at = found(g, wanted)
            doc = np.searchsorted(first, at, side="right") - 1
            yield k, g, at[at + k <= first[doc + 1]]


def _seen(docs: DataFrame, index: Windows) -> dict[tuple[int, int], int]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = defaultdict(int)
        for chunk in text_chunks(batches):
            _, _, _, first, h = _words(chunk)
            for k, g, at in _matches(h, first, index):
                for x, n in zip(*np.unique(g[at], return_counts=True), strict=True):
                    total[k, int(x)] += int(n)
        rows = [(k, int(np.uint64(x).astype(np.int64)), n) for (k, x), n in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ("k", "h", "n"))

    rows = docs.select("text").mapInArrow(count, "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n")).collect()  # no more than a block's shingles
    return {(r["k"], r["h"] % (1 << 64)): r["n"] for r in rows}


def _hits(docs: DataFrame, index: Windows, only_hit: bool) -> DataFrame:
    """row, doc_id (as in docs), n_words, spans (hit words as start, end, ... ; merged), items (whose windows occur)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            data, starts, ends, first, h = _words(chunk)
            spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
            items: dict[int, set[str | None]] = defaultdict(set)
            for k, g, at in _matches(h, first, index):
                for p, d in zip(at.tolist(), (np.searchsorted(first, at, side="right") - 1).tolist(), strict=True):
                    for w, o in index.postings[k, int(g[p])]:
                        a = p - o
                        b = a + int(index.sizes[w])
                        if a < first[d] or b > first[d + 1]:
                            continue
                        if all(data[starts[i] : ends[i]].tobytes() == x for i, x in zip(range(a, b), index.words[w], strict=True)):
                            spans[d].append((a - int(first[d]), b - int(first[d])))
                            items[d].update(index.owners[w])
            rows = []
            for d, (row, doc_id) in enumerate(zip(chunk.column("row").to_pylist(), chunk.column("doc_id").to_pylist(), strict=True)):
                if d in spans or not only_hit:
                    flat: list[int] = []
                    for a, b in sorted(spans.get(d, ())):
                        if flat and a <= flat[-1]:
                            flat[-1] = max(flat[-1], b)
                        else:
                            flat += (a, b)
                    rows.append((row, doc_id, int(first[d + 1] - first[d]), flat, sorted(items.get(d, ()), key=lambda x: (x is None, x))))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ("row", "doc_id", "n_words", "spans", "items"))

    return docs.select("row", "doc_id", "text").mapInArrow(search, "row long, doc_id long, n_words long, spans array<long>, items array<string>")


def item_pieces(benchmark: DataFrame, window: int, most: int) -> DataFrame:
    """(item_id, text, n): the items' texts, long ones cut so that a piece has ``n`` windows, ``most`` at the most.

    Neighbouring pieces share ``window`` - 1 words, so that together they have the item's windows and no others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            data, offsets = text_bytes(chunk.column("text"))
            starts, ends, first = word_spans(data, offsets, ALNUM)
            item, texts, n = [], [], []
            for d in range(chunk.num_rows):
                a, b = int(first[d]), int(first[d + 1])
                for k in range(a, max(b - window + 1, a + 1) if b > a else a, most):
                    end = min(k + most + window - 1, b)
                    item.append(d)
                    texts.append(data[starts[k] : ends[end - 1]].tobytes().decode())
                    n.append(max(1, end - k - window + 1))
            rows = chunk.select(["item_id"]).take(pa.array(item, pa.int64())).column("item_id")
            yield pa.RecordBatch.from_arrays([rows, pa.array(texts, pa.string()), pa.array(n, pa.int64())], ("item_id", "text", "n"))

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.select("item_id", "text").mapInArrow(run, f"item_id {kind}, text string, n long")


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 5, block_windows: int = BLOCK_WINDOWS, row: str | None = None) -> DataFrame:
    """Every document with its words that lie in an occurrence of an item's window.

    docs: doc_id, text; benchmark: item_id, text; other columns are not looked at. Result: doc_id, n_words, spans
    (merged word ranges as start, end, start, end, ...), items (ids as sorted strings, then a null for all items without
    id). A null or empty text has no words; an item without words has no window; one of fewer than ``window`` words is a
    window itself. Rows that repeat an item are one. Rows that repeat a document each get their result. ``row`` names a column of docs with a stored key of
    each row; the result then has it too.

    The items are read in blocks of about ``block_windows`` windows; a long item is divided among blocks. One block, the
    usual case, needs two passes over the documents and no shuffle of them. Of more blocks one after the other is
    searched for and its hits are stored, so that the driver and the tasks hold one block's index at a time; the hits
    are merged by the row's key, for which docs without ``row`` are stored once.
    """
    bench = checkpointed(item_pieces(benchmark, window, max(1, block_windows // 4)).distinct())  # repeated rows would meet in one block
    n_blocks = max(1, -(-int(bench.agg(F.sum("n")).first()[0] or 0) // block_windows))
    wanted = [*([F.col("row").alias(row)] if row else []), "doc_id", "n_words"]
    key = F.col(row) if row else F.monotonically_increasing_id() if n_blocks > 1 else F.lit(None)
    docs = docs.select(key.cast("long").alias("row"), F.col("doc_id").cast("long"), "text")
    if n_blocks > 1 and not row:
        docs = stored(docs)
    parts = []
    for k in range(n_blocks):
        mine = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k) if n_blocks > 1 else bench
        index = Windows([tuple(r) for r in mine.select("item_id", "text").collect()], window, shingle)  # a block: bounded
        if index.words:
            index.choose(_seen(docs, index))
        elif n_blocks > 1:
            continue
        hits = _hits(docs, index, only_hit=n_blocks > 1)
        parts.append(checkpointed(hits) if n_blocks > 1 else hits)
    if n_blocks == 1:
        return parts[0].select(*wanted, "spans", "items")
    empty = Windows([], window, shingle)
    out = _hits(docs, empty, only_hit=False).select("row", "doc_id", "n_words")
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    hits = hits.groupBy("row").agg(F.collect_list("spans").alias("many"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    pairs = F.expr("array_sort(flatten(transform(many, s -> transform(sequence(0, cast(size(s) / 2 as int) - 1), i -> array(s[2 * i], s[2 * i + 1])))))")
    glue = lambda acc, p: F.when((F.size(acc) > 0) & (p[0] <= F.element_at(acc, -1)), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.greatest(F.element_at(acc, -1), p[1])))).otherwise(F.concat(acc, p))
    hits = hits.select("row", F.aggregate(pairs, F.array().cast("array<long>"), glue).alias("spans"), "items")
    none = F.array()
    return out.join(hits, "row", "left").select(*wanted, F.coalesce("spans", none.cast("array<long>")).alias("spans"), F.coalesce("items", none.cast("array<string>")).alias("items"))


def report(spans: DataFrame) -> DataFrame:
    """The digest of ``contaminated_spans``: a document is contaminated if a twentieth of its words or more is hit.

    Items without id count as one item, which is not in the digest. Further columns stay.
    """
    n_hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return spans.select(
        *(c for c in spans.columns if c not in ("spans", "items")),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS win
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, bw.n FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
"""
