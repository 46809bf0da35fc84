"""Operator 6: SimHash near-duplicates through covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lobspark.llm.common import checkpointed, joined_unevenly, table

BITS = 64

#: For each byte value its bits as eight counters in one integer, the lowest bit in the lowest byte.
SPREAD = np.array([sum(1 << (8 * i) for i in range(8) if b >> i & 1) for b in range(256)], np.uint64)


def fingerprint(text: str | None, size: int = 4) -> int:
    """Bit i is set if it is set in over half of the XXH64 hashes (seed 42) of the text's shingles of ``size`` words.

    A-Z count as a-z; words are what ASCII white space separates; shingles count as often as they occur; a text of fewer
    words is one shingle; one without words (or null) has fingerprint 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > size:
        starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    of = xxhash.xxh64_intdigest
    h = np.fromiter((of(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    set_in = np.zeros(BITS, np.int64)
    octets = h.view(np.uint8).reshape(-1, 8)
    for a in range(0, len(h), 255):  # no counter overflows
        sums = SPREAD[octets[a : a + 255]].sum(axis=0, dtype=np.uint64)
        set_in += sums.view(np.uint8)
    bits = np.flatnonzero(2 * set_in > len(h))
    return int(sum(1 << int(i) for i in bits))


def fingerprints(docs: DataFrame, size: int = 4, more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, then the 64-bit integers ``more`` as they are), fp signed, a row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), *batch.columns[2:]], ("doc_id", "fp", *more))

    return docs.select(F.col("doc_id").cast("long"), "text", *more).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *more)))


def covering_masks(radius: int, bits: int = BITS, seed: int = 7) -> list[int]:
    """2**(radius + 1) - 1 masks such that any ``radius`` positions or fewer are all left out of some mask.

    Position i gets a vector m(i) of radius + 1 bits; the mask of a non-zero vector v keeps the positions with an odd
    product <m(i), v>. The even ones include any given positions D for some v: |D| <= radius linear conditions on
    radius + 1 bits leave a non-zero v. Each m(i) is non-zero and all values are dealt out evenly.
    """
    d = radius + 1
    values = np.arange(bits) % ((1 << d) - 1) + 1
    m = np.random.Generator(np.random.PCG64(seed)).permutation(values)
    return [sum(1 << i for i in range(bits) if bin(int(m[i]) & v).count("1") % 2) for v in range(1, 1 << d)]


def forest(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that links fingerprints at ``radius`` differing bits or fewer.

    Breadth first: each fingerprint that is reached is compared once with all those not yet reached, at once.
    """
    rest, edges = fp.astype(np.uint64), []
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                got, rest = rest[near], rest[~near]
                edges += [(int(x), int(y)) for y in got]
                front += list(got)
    return edges


def links(fps: DataFrame, n_fps: int, radius: int = 4, block: int = 4096) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, as many as connect what is linked in each bucket.

    fps: ``n_fps`` distinct values ``fp``. Each goes to one bucket for each covering mask. A bucket of over ``block`` members is
    divided into blocks by hash, and each pair of blocks is compared in a group of its own. Buckets are counted by
    partial sums first and the counts of hot ones are broadcast, so that no task gets a whole hot bucket. A group
    emits a spanning forest, never all pairs. Pairs of different blocks found linked twice do no harm.
    """
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in covering_masks(radius)])
    keyed = fps.select("fp", F.posexplode(masks).alias("t", "mask")).select("t", F.expr("fp & mask").alias("key"), "fp")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("many", F.col("n"))
    hot = joined_unevenly(keyed, sizes, ["t", "key"], "many", len(covering_masks(radius)) * n_fps)
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(11)), blocks).cast("int")
    other = F.sequence(F.lit(0), blocks - 1)
    hot = hot.select("t", "key", "fp", own.alias("own"), F.explode(other).alias("other"))
    pair = hot.select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    dealt = pair.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_key, kept = None, []

        def close() -> list[tuple[int, int]]:
            return forest(np.concatenate(kept).view(np.uint64), radius) if kept else []

        def out(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            e = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], ("a", "b"))

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy() for k in range(4)]
            fp = batch.column(4).to_numpy()
            new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
            edges: list[tuple[int, int]] = []
            for a, b in zip([0, *new], [*new, len(fp)], strict=True):
                key = tuple(int(c[a]) for c in cols)
                if key != kept_key:
                    edges += close()
                    kept_key, kept = key, []
                kept.append(fp[a:b].copy())
            yield out(edges)
        yield out(close())

    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, most_turns: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of the undirected edges (a, b) is connected with.

    Every turn points each node's larger neighbours, then its smaller ones, to its smallest neighbour (large star,
    small star) until nothing changes; the number of turns grows as the logarithm of the longest path. Only links
    between distinct nodes are moved, and each turn is checkpointed.
    """
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n_now, mark = now.count(), None
    for _ in range(most_turns):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = joined_unevenly(both, low, "a", "n", 2 * n_now).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = joined_unevenly(large, low, "a", "n", 2 * n_now).select(F.col("b").alias("x"), "m").where("x <> m").unionByName(low.select(F.col("a").alias("x"), "m"))
        now = checkpointed(small.select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).distinct())
        new = tuple(now.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first())
        if new == mark:
            break
        n_now, mark = new[0], new
    else:
        raise RuntimeError("the components didn't settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def rooted(lowest: DataFrame, radius: int) -> DataFrame:
    """The stored ``lowest`` (fp and more; distinct fingerprints) with root: equal roots are one component."""
    root = components(links(lowest.select("fp"), lowest.count(), radius))
    return lowest.join(root, F.col("fp") == F.col("node"), "left").select(*lowest.columns, F.coalesce("root", "fp").alias("root"))


def representatives(docs: DataFrame, radius: int = 4, size: int = 4) -> DataFrame:
    """(row): of each component as in ``classes`` one row of docs (doc_id, text, tie, row), by its own key ``row``.

    It has the smallest doc_id; null is the largest. Among rows of that id the smallest (tie, row) is taken.
    """
    marked = fingerprints(docs, size, ("tie", "row"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "row")
    known = rooted(checkpointed(marked.groupBy("fp").agg(F.min(order).alias("low"))), radius)
    return known.groupBy("root").agg(F.min("low").alias("low")).select("low.row")


def classes(docs: DataFrame, radius: int = 4, size: int = 4) -> DataFrame:
    """A row for each row of docs: doc_id, fingerprint (16 lowercase hex digits), component_id.

    component_id is the smallest doc_id that can be reached over links of ``radius`` differing bits or fewer, the
    document's own included. Equal fingerprints are one node from the start, however many documents share them. Nulls
    and texts without words have fingerprint 0 and are linked like others; a null doc_id is never the smallest one.
    Neither a common fingerprint nor a large component meets in one task.
    """
    marked = checkpointed(fingerprints(docs, size))
    lowest = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n_docs")))
    known = checkpointed(rooted(lowest, radius))
    ids = known.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    n_fps, n_docs = known.agg(F.count("*"), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    by_fp = joined_unevenly(known.select("fp", "n_docs", "root"), ids, "root", "n", n_fps).select("fp", "n_docs", "component_id")
    out = joined_unevenly(marked, by_fp, "fp", "n_docs", n_docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
