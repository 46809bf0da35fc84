"""Operator 9: best-fit packing whose bin counts are certified by dual-feasible functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lobspark.llm.common import checkpointed, table
from lobspark.llm.tokens import pieces


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing of ``counts[s]`` items of each size s into bins of ``capacity`` has fewer bins than this.

    A dual-feasible function never maps a full bin above 1, so the sum over all items of any such function bounds the
    bins from below. Tried are the identity; for each e up to half the capacity the function that rounds sizes above
    capacity - e up to 1 and those below e down to 0; and for k up to 64 the one that rounds to k-ths.
    """
    c, size = capacity, np.arange(len(counts), dtype=np.int64)
    n = counts.astype(np.int64)
    total = int((n * size).sum())
    best = -(-total // c)
    many, mass = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * size)])
    e = np.arange(1, c // 2 + 1)
    large = many[-1] - many[c - e + 1]
    middle = mass[c - e + 1] - mass[e]
    if len(e):
        best = max(best, int((-(-(large * c + middle) // c)).max()))
    for k in range(1, 65):
        exact = size * (k + 1) % c == 0
        scaled = np.where(exact, size * k, size * (k + 1) // c * c)  # in units of 1 / (k * c)
        best = max(best, -(-int((n * scaled).sum()) // (k * c)))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing. For each item its bin and its offset there, and each bin's fill.

    Bins are kept by what is left in them, with an integer as a set of bits for "some bin has exactly this left".
    """
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    left: list[list[int]] = [[] for _ in range(capacity + 1)]
    have, fill = 0, []
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = have >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = left[r].pop()
            if not left[r]:
                have &= ~(1 << r)
        else:
            r, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += s
        if r > s:
            left[r - s].append(b)
            have |= 1 << (r - s)
    return bins, offsets, np.array(fill, np.int64)


COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _packed(items: DataFrame, n: int, capacity: int, turn: int, per_task: int) -> DataFrame:
    """One run of best-fit decreasing in each of n / per_task partitions. ``gap``: bins above the partition's bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if got is None or not got.num_rows:
            return
        sizes = got.column("length").to_numpy().astype(np.int64)
        bins, offsets, fill = best_fit(sizes, capacity)
        gap = len(fill) - lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        first = (turn << 56) | (TaskContext.get().partitionId() << 32)
        more = {"sequence_id": bins + first, "offset": offsets, "fill": fill[bins], "gap": np.full(len(bins), gap)}
        for name, values in more.items():
            got = got.append_column(name, pa.array(values, pa.int64()))
        yield from got.to_batches(max_chunksize=50_000)

    parts = max(1, -(-n // per_task))
    dealt = items.repartition(parts, F.xxhash64("row", F.lit(turn)))
    return dealt.mapInArrow(run, f"{COLUMNS}, row long, sequence_id long, offset long, fill long, gap long")


def pack(items: DataFrame, capacity: int = 2048, per_task: int = 100_000) -> DataFrame:
    """Items (columns of ``pieces``, each of at most ``capacity``) with sequence_id and offset, and the certificate.

    Every partition packs its own items and compares its count with their ``lower_bound``. A partition without a gap is
    certified and keeps its sequences. Those with gaps exchange items: what lies in their bins with room left is dealt
    anew among them, in fewer partitions, and packed again. This is repeated as long as it saves bins, two partitions
    have gaps and the total is above the bound of all items; a turn that saves none is undone.

    ``certified``: the sequence's partition met its bound. ``n_sequences`` and ``lower_bound``, the same in each row: the
    total, and what no packing of all items can go below. A task gets about ``per_task`` items, narrow rows
    without texts or ids, dealt by a stored number of each row. An empty table gives no rows; repeated rows are packed
    as often as they occur.
    """
    pool = checkpointed(items.withColumn("row", F.monotonically_increasing_id()))
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in pool.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[size] = n
    bound, n_pool = lower_bound(counts, capacity), int(counts.sum())
    open_bins = (F.col("gap") > 0) & (F.col("fill") < capacity)
    done, n_done, before, turn = [], 0, None, 0
    while True:
        packed = checkpointed(_packed(pool, n_pool, capacity, turn, per_task))
        part = F.shiftright("sequence_id", 32)
        now = packed.agg(
            F.count_if(F.col("offset") == 0).alias("bins"),
            F.count_if((F.col("offset") == 0) & open_bins).alias("open"),
            F.count_if(open_bins).alias("items"),
            F.min(F.when(F.col("gap") > 0, part)).alias("first"),
            F.max(F.when(F.col("gap") > 0, part)).alias("last"),
        ).first()
        if before is not None and now["bins"] >= before[1]:
            packed, n = before  # the turn saved nothing
            done.append(packed)
            n_done += n
            break
        if n_done + now["bins"] <= bound or now["first"] == now["last"]:
            done.append(packed)
            n_done += now["bins"]
            break
        done.append(packed.where(~open_bins))
        n_done += now["bins"] - now["open"]
        before = packed.where(open_bins), now["open"]
        pool, n_pool, turn = before[0].select(*pool.columns), now["items"], turn + 1
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    out = None
    for rows in done:
        rows = rows.select(*names, "sequence_id", "offset", (F.col("gap") <= 0).alias("certified"))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumns({"n_sequences": F.lit(n_done).cast("long"), "lower_bound": F.lit(bound).cast("long")})


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))
