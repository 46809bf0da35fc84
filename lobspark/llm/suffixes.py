"""Operator 4: deduplication of byte strings by a hash-compared suffix sort.

In each shard (see ``shared``) the suffixes that begin a window are sorted by merging; two suffixes are compared by
binary search for their common extension over prefix polynomial hashes, so a comparison takes logarithmic time, and all
merges of a pass run at once as array operations. Neighbours in the order with a common extension of a whole window
are equal windows; their bytes are compared too, and should a hash ever have collided, the block is redone by bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lobspark.llm.common import mixed, powers, prefix_hash, signed, span_hash, table, text_bytes
from lobspark.llm.shared import Units, fresh_runs, removed_count, removed_spans

SHARD_BYTES = 256_000


def step_hashes(data: np.ndarray, most: int) -> list[tuple[int, np.ndarray]]:
    """For the powers of two up to ``most``, largest first, the hash of the substring of that length at every place."""
    s = prefix_hash(data)
    inverse, out = powers(len(s))[1], []
    step = 1 << (most.bit_length() - 1)
    while step:
        h = np.zeros(len(s), np.uint64)  # places too near to the end are never asked for
        if step < len(s):
            h[: len(s) - step] = (s[step:] - s[:-step]) * inverse[: len(s) - step]
        out.append((step, h))
        step >>= 1
    return out


def common_extension(hashes: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Of each pair of suffixes the length of their common prefix, up to ``most``, by binary search over the hashes."""
    out = np.zeros(len(a), np.int64)
    for step, h in hashes:
        ok = h[a + out] == h[b + out]
        ok &= out <= most - step
        out += ok * step
    return out


def merge_sorted(data: np.ndarray, hashes: list[tuple[int, np.ndarray]], at: np.ndarray, bucket: np.ndarray, most: int) -> np.ndarray:
    """The order of the suffixes ``at`` within their buckets (given together) by their first ``most`` bytes, stably."""
    n = len(at)
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    sizes = np.diff(np.append(edges, n))
    base, size = np.repeat(edges, sizes), np.repeat(sizes, sizes)
    order = np.arange(n)
    width, largest = 1, int(sizes.max(initial=0))
    while width < largest:
        t = np.arange(n) - base  # place in the bucket
        run = t // width
        sibling = run ^ 1
        lo = np.minimum(sibling * width, size)
        hi = np.minimum(lo + width, size)
        begin, left = lo.copy(), run % 2 == 0
        active = np.flatnonzero(lo < hi)
        while len(active):
            mid = (lo[active] + hi[active]) // 2
            mine, other = at[order[active]], at[order[base[active] + mid]]
            k = common_extension(hashes, mine, other, most)
            same = k >= most
            i = np.where(same, 0, k)
            less = np.where(same, ~left[active], data[other + i] < data[mine + i])  # the other one comes first
            lo[active] = np.where(less, mid + 1, lo[active])
            hi[active] = np.where(less, hi[active], mid)
            active = active[lo[active] < hi[active]]
        target = base + np.minimum(run, sibling) * width + (t - run * width) + (lo - begin)
        merged = np.empty(n, np.int64)
        merged[target] = order
        order = merged
        width *= 2
    return order


def equal_classes(data: np.ndarray, at: np.ndarray, bucket: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the windows ``at`` and whether each one equals the one before it. Equal windows share a bucket."""
    hashes = step_hashes(data, window)
    order = merge_sorted(data, hashes, at, bucket, window)
    p, b = at[order], bucket[order]
    near = np.flatnonzero(b[1:] == b[:-1]) + 1
    equal = np.zeros(len(at), bool)
    equal[near] = common_extension(hashes, p[near - 1], p[near], window) >= window
    offsets = np.arange(window)
    pairs = np.flatnonzero(equal)
    for k in range(0, len(pairs), 20_000):
        i = pairs[k : k + 20_000]
        if not (data[p[i - 1][:, None] + offsets] == data[p[i][:, None] + offsets]).all():
            rows = np.ascontiguousarray(data[at[:, None] + offsets]).view(f"V{window}")[:, 0]
            _, kind = np.unique(rows, return_inverse=True)
            order = np.argsort(kind, kind="stable")
            return order, np.concatenate([[False], np.diff(kind[order]) == 0])
    return order, equal


def repeats_within(data: np.ndarray, at: np.ndarray, row: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that equal an earlier one of their own context (text of a short period), and that one each.

    Found by their hashes, compared by their bytes.
    """
    if not len(at):
        return at, at
    h = span_hash(prefix_hash(data), at, at + window)
    order = np.lexsort((at, h, row))
    new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])])
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    again, first = order[~new], first[~new]
    fine = np.ones(len(again), bool)
    offsets = np.arange(window)
    for k in range(0, len(again), 20_000):
        part = slice(k, k + 20_000)
        fine[part] = (data[at[again[part]][:, None] + offsets] == data[at[first[part]][:, None] + offsets]).all(1)
    return again[fine], first[fine]


def first_by_suffix_sort(units: Units):
    """A window is fresh in the documents with the smallest doc_id among those that have it."""

    def decide(block: pa.Table) -> list[tuple[int, int, int, int]]:
        h = block.column("h").to_numpy()
        alone = np.concatenate([[True], h[1:] != h[:-1]]) & np.concatenate([h[1:] != h[:-1], [True]])
        single = [block.column(k).to_numpy()[alone].tolist() for k in ("doc_id", "key", "rel", "n")]
        return [*zip(*single, strict=True), *compared(block.filter(pa.array(~alone)))]  # nothing to compare an only context with

    def compared(block: pa.Table) -> list[tuple[int, int, int, int]]:
        if not block.num_rows:
            return []
        doc, key, rel, h = (block.column(k).to_numpy().astype(np.int64) for k in ("doc_id", "key", "rel", "h"))
        data, offsets = text_bytes(block.column("ctx").combine_chunks())
        w, n = units.window, np.diff(offsets) - units.window + 1
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = offsets[row] + place
        group = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))
        # windows of one anchor are aligned at it: equal ones stand at the same distance before it
        g = np.arange(len(data) - units.gram + 1)
        anchor = np.flatnonzero(signed(mixed(span_hash(prefix_hash(data), g, g + units.gram)) | np.uint64(1)) == np.repeat(h, np.diff(offsets))[: len(g)])
        ahead = np.append(anchor, len(data) * 2)[np.searchsorted(anchor, at)] - at
        bucket = group[row] * (w + 1) + np.where(ahead <= w - units.gram, ahead, w)
        fresh = np.ones(len(at), bool)
        long = np.flatnonzero(n[row] > 4 * w)
        again, first = (long[x] for x in repeats_within(data, at[long], row[long], w))
        once = np.ones(len(at), bool)
        once[again] = False
        by = np.flatnonzero(once)
        by = by[np.argsort(bucket[by], kind="stable")]
        sorted_bucket = bucket[by]
        same = sorted_bucket[1:] == sorted_bucket[:-1]
        many = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        by = by[many]
        if len(by):
            order, equal = equal_classes(data, at[by], bucket[by], w)
            by = by[order]
            starts = np.flatnonzero(~equal)
            least = np.minimum.reduceat(doc[row[by]], starts)
            fresh[by] = doc[row[by]] == np.repeat(least, np.diff(np.append(starts, len(by))))
        fresh[again] = fresh[first]
        return fresh_runs(fresh, row, doc, key, place + rel[row])

    return decide


def deduplicated(docs: DataFrame, window: int = 50, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Removes every byte under a string of ``window`` bytes that a smaller doc_id has too; see ``removed_spans``."""
    units = Units(window=window, gram=max(1, window * 2 // 5), words=False, other_document=True, hot=4000)
    return removed_spans(docs, units, first_by_suffix_sort(units), shard_bytes)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents"))
    n_spans = F.floor(F.size("spans") / 2).cast("long")
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), removed_count().alias("n_removed"), n_spans.alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes as pairs of hex digits: the window from byte i on is 100 digits from digit 2 i - 1 on.
OP4_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, len(h) // 2 AS n FROM d),
win AS (SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS s FROM (SELECT doc_id, h, unnest(generate_series(1, n - 49)) AS i FROM n WHERE n >= 50)),
first AS (SELECT s, min(doc_id) AS low FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
again AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER w <= 50 THEN 0 ELSE 1 END AS fresh FROM win JOIN first USING (s) WHERE low < doc_id WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 49 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM again) GROUP BY doc_id, k),
cut AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER w AS last FROM (SELECT * FROM runs UNION ALL SELECT doc_id, n + 1, NULL FROM n) WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * last + 1, 2 * (a - 1 - last)), '' ORDER BY a) AS s FROM cut JOIN n USING (doc_id) GROUP BY doc_id),
lost AS (SELECT doc_id, sum(b - a + 1) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.s, ''))) AS kept_sha256
FROM n LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""
