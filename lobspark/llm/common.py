"""Helpers the corpus operators share: table access, checkpoints, and vectorised work on Arrow text.

Texts are handled as UTF-8 bytes. A batch of texts is one byte array plus offsets, and words,
hashes and windows are NumPy arrays over it, so Python never loops over single words.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task; a longer document makes a chunk of its own.
CHUNK_BYTES = 2 << 20

#: The odd base of the polynomial hash (mod 2**64), and random values for the 256 bytes.
BASE = 0x9E3779B97F4A7C13
BASE_INV = pow(BASE, -1, 1 << 64)
_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Word classes by byte: what is not ASCII white space, and letters, digits and non-ASCII characters.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
ALNUM[0x41:0x5B] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table; documents that come in fewer parts than there are cores, as a small file does, are dealt over these."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where that is unset a local session gets a folder; a cluster must set it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Most keys that count as hot in a join, and the fewest rows of one.
MOST_HOT, LEAST_HOT = 1_000_000, 500


def hot_above(n_rows: int) -> int:
    """More rows than this make a key hot among ``n_rows``, so that no more than MOST_HOT keys are."""
    return max(LEAST_HOT, n_rows // MOST_HOT)


def joined_unevenly(rows: DataFrame, by: DataFrame, key: str | list[str], n: str, n_rows: int) -> DataFrame:
    """``rows`` joined with ``by``, which has each key once, and in ``n`` how many of the ``n_rows`` rows have it.

    The rows of a hot key stay where they are: hot keys are broadcast, as there are at most MOST_HOT (see ``hot_above``).
    The others are shuffled by key as usual. Columns: those of rows, then those of by without key and n.
    """
    keys = [key] if isinstance(key, str) else key
    values = [c for c in by.columns if c not in (*keys, n)]
    hot = by.where(F.col(n) > hot_above(n_rows)).select(*keys, *values)
    cold = by.where(F.col(n) <= hot_above(n_rows)).select(*keys, *values)
    wanted = [*rows.columns, *values]
    near = rows.join(F.broadcast(hot), keys).select(*wanted)
    far = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys).select(*wanted)
    return near.unionByName(far)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def text_chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of about ``limit`` bytes of the column ``text``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = text_bytes(batch.column("text"))[1]
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins, ending with the total. A null is an empty text."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if large else np.int32
    offsets = np.frombuffer(offs, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    flat = np.frombuffer(data, np.uint8, last - first, first) if last > first else np.zeros(0, np.uint8)
    return flat, offsets - first


def word_spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``member`` bytes, and the first word of each text (with the total).

    No word goes from one text into the next.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = member[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n or more."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        both = []
        for base in (BASE, BASE_INV):
            p = np.ones(size, np.uint64)
            done, step = 1, base
            while done < size:
                p[done : 2 * done] = p[:done] * np.uint64(step)
                done, step = 2 * done, step * step % (1 << 64)
            both.append(p)
        _POWERS[0] = have = tuple(both)
    return have


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[i] the hash of data[:i]; span_hash reads any span's hash from it."""
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(len(data))[0][: len(data)], out=s[1:])
    return s


def span_hash(s: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal spans of bytes have equal hashes, wherever they stand."""
    return (s[ends] - s[starts]) * powers(len(s))[1][starts]


def same_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Which spans a to b of ``data`` have the same bytes as the spans c to d. ``most`` bytes are compared at once."""
    size = b - a
    out = size == d - c
    todo = np.flatnonzero(out & (a != c) & (size > 0))
    total = np.cumsum(size[todo])
    at = 0
    while at < len(todo):
        end = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")), at + 1)
        part = todo[at:end]
        n = size[part]
        if len(part) == 1:
            k = int(part[0])
            out[k] = np.array_equal(data[a[k] : b[k]], data[c[k] : d[k]])
        else:
            first = np.cumsum(n) - n
            step = np.arange(int(n.sum())) - np.repeat(first, n)
            out[part] = np.logical_and.reduceat(data[np.repeat(a[part], n) + step] == data[np.repeat(c[part], n) + step], first)
        at = end
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose results look random in every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k consecutive values; the result is k - 1 shorter (or empty)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    a = 0xD1342543DE82EF95
    out, have, by = h[: len(h)], 1, {1: (h, a)}
    while have * 2 <= k:
        g, m = by[have]
        by[have * 2] = (g[: len(g) - have] * np.uint64(m) + g[have:], m * m % (1 << 64))
        have *= 2
    out, done, rest = by[have][0], have, k - have
    for size in sorted((s for s in by if s < have), reverse=True):
        if rest >= size:
            g, m = by[size]
            n = len(out) - size
            out = out[:n] * np.uint64(m) + g[done : done + n]
            done, rest = done + size, rest - size
    return mixed(out[: len(h) - k + 1])


def runs(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers from each start to its end, one run after the other."""
    n = ends - starts
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values; the result is w - 1 shorter (or empty)."""
    if len(v) < w:
        return v[:0]
    out, have = v, 1
    while have * 2 <= w:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    if have < w:
        out = np.minimum(out[: len(v) - w + 1], out[w - have : w - have + len(v) - w + 1])
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def bucketed(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``: the folds of the labelled rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus
