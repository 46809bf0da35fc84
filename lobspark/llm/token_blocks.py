"""Operator 11: token ids in binary files of patched frame-of-reference blocks, written and read through Spark.

A file holds whole documents and is read on its own. All numbers are little-endian:

- blocks of ``BLOCK`` ids, the last one shorter: minimum (4 bytes), width (1), number of ids (2) and of exceptions (2), then
  each id less the minimum in ``width`` bits, then the exceptions' positions (2 each) and their whole differences (4 each);
- for each document: whether it has an id (1 byte), the id (8), its number of ids (8);
- where each block starts (8 bytes each);
- a trailer: part, file of the part, ids before it in its part, ids, documents, blocks (8 bytes each), ``MAGIC``, and a line feed.

The width is that of the difference which the given share of a block's ids does not exceed; larger ones are
exceptions. Files go through Spark's text writer, a row a file: bytes pass it unchanged but for the line feed after
a row, and its commit protocol leaves one copy of a retried task's files on any store. They come back as binary files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lobspark.llm.common import shared_folder, table
from lobspark.llm.tokens import Encoder, paths

MAGIC = b"PFRB"
BLOCK = 1024
HEAD = struct.Struct("<IBHH")
TRAILER = struct.Struct("<6q4s")
END = b"\n"

#: Blocks that are packed at once.
AT_ONCE = 256

#: Ids after which a file is closed: some 14 MB of it.
FILE_IDS = 8 << 20


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """The rows' values, each in ``width`` bits from the lowest on, as bytes. 64 values fill ``width`` words."""
    rows, n = values.shape
    v = np.zeros((-(-n // 64), 64, rows), np.uint64)
    v.reshape(-1, rows)[:n] = values.T
    out = np.zeros((len(v), width, rows), "<u8")
    for k in range(64):
        word, shift = divmod(k * width, 64)
        out[:, word] |= v[:, k] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= v[:, k] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.reshape(-1, rows).T).view(np.uint8)[:, : -(-n * width // 8)]


def _values(packed: np.ndarray, width: int, n: int) -> np.ndarray:
    """The first ``n`` values of each row of ``packed``."""
    rows, groups = len(packed), -(-n // 64)
    whole = np.zeros((rows, groups * width * 8), np.uint8)
    whole[:, : packed.shape[1]] = packed
    w = np.ascontiguousarray(whole.view("<u8").T).reshape(groups, width, rows)
    out, mask = np.empty((groups, 64, rows), np.uint64), np.uint64((1 << width) - 1)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        got = w[:, word] >> np.uint64(shift)
        if shift + width > 64:
            got |= w[:, word + 1] << np.uint64(64 - shift)
        out[:, k] = got & mask
    return out.reshape(-1, rows)[:n].T.astype(np.uint32)


def pack(ids: np.ndarray, share: float = 0.98, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """The blocks of unsigned 32-bit ids, and where each one starts."""
    out, sizes = [], []
    whole = len(ids) // block * block
    for values in (*np.split(ids[:whole].reshape(-1, block), range(AT_ONCE, whole // block, AT_ONCE)), ids[whole:].reshape(1, -1)):
        if not values.size:
            continue
        n = values.shape[1]
        least = values.min(axis=1)
        above = values - least[:, None]
        bound = np.partition(above, (k := max(int(np.ceil(share * n)) - 1, 0)), axis=1)[:, k]
        widths = np.where(bound > 0, np.floor(np.log2(np.maximum(bound, 1))).astype(np.int64) + 1, 0)
        packed: list[bytes] = [b""] * len(values)
        for w in np.unique(widths[widths > 0]).tolist():
            of = np.flatnonzero(widths == w)
            for i, row in zip(of.tolist(), _bits(above[of] & np.uint32((1 << w) - 1), w), strict=True):
                packed[i] = row.tobytes()
        row, place = np.nonzero(above > ((1 << widths) - 1).astype(np.uint32)[:, None])
        many = np.bincount(row, minlength=len(values))
        ends = np.cumsum(many)
        for i, (w, lo, e, m) in enumerate(zip(widths.tolist(), least.tolist(), ends.tolist(), many.tolist(), strict=True)):
            at = place[e - m : e]
            out.append(HEAD.pack(lo, w, n, m) + packed[i] + at.astype("<u2").tobytes() + above[i, at].astype("<u4").tobytes())
            sizes.append(len(out[-1]))
    return b"".join(out), np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])[: len(sizes)].astype(np.int64)


def unpack(raw: bytes | memoryview, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start there."""
    data = np.frombuffer(raw, np.uint8)
    heads = [HEAD.unpack_from(raw, s) for s in starts.tolist()]
    first = np.concatenate([[0], np.cumsum([h[2] for h in heads], dtype=np.int64)]).astype(np.int64)
    out = np.empty(int(first[-1]), np.uint32)
    alike: dict[tuple[int, int], list[int]] = {}
    for i, (_, w, n, _m) in enumerate(heads):
        alike.setdefault((w, n), []).append(i)
    for (w, n), every in alike.items():
        size = -(-w * n // 8)
        for k in range(0, len(every), AT_ONCE):
            of = np.array(every[k : k + AT_ONCE])
            low = np.array([heads[i][0] for i in of], np.uint32)[:, None]
            got = _values(data[starts[of][:, None] + HEAD.size + np.arange(size)], w, n) if w else np.zeros((len(of), n), np.uint32)
            out[first[of][:, None] + np.arange(n)] = got + low
    for i, (lo, w, n, m) in enumerate(heads):
        if m:
            at = int(starts[i]) + HEAD.size + -(-w * n // 8)
            places = np.frombuffer(raw, "<u2", m, at)
            out[first[i] + places] = np.frombuffer(raw, "<u4", m, at + 2 * m) + np.uint32(lo)
    return out


def file_bytes(doc_ids: list[int | None], ids: list[np.ndarray], part: int = 0, number: int = 0, before: int = 0) -> bytes:
    """A whole file but for the line feed."""
    every = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    blocks, starts = pack(every)
    index = np.array([(i is not None, i or 0, len(x)) for i, x in zip(doc_ids, ids, strict=True)], "<u1,<i8,<i8")
    return blocks + index.tobytes() + starts.astype("<i8").tobytes() + TRAILER.pack(part, number, before, len(every), len(doc_ids), len(starts), MAGIC)


class TokenFile:
    """A file's documents, and any run of its ids from the blocks that hold them."""

    def __init__(self, raw: bytes | memoryview):
        self.raw = raw
        at = len(raw) - TRAILER.size - len(END)
        if at < 0 or bytes(raw[-len(END) :]) != END:
            raise ValueError("not a token block file, or cut short")
        self.part, self.number, self.before, self.n_ids, n_docs, n_blocks, magic = TRAILER.unpack_from(raw, at)
        if magic != MAGIC:
            raise ValueError("not a token block file")
        self.starts = np.frombuffer(raw, "<i8", n_blocks, at - 8 * n_blocks)
        index = np.frombuffer(raw, "<u1,<i8,<i8", n_docs, at - 8 * n_blocks - 17 * n_docs)
        self.doc_ids, self.sizes = [i if has else None for has, i in zip(index["f0"].tolist(), index["f1"].tolist(), strict=True)], index["f2"].astype(np.int64)

    def ids(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """The file's ids from a to b - 1."""
        b = self.n_ids if b is None else min(b, self.n_ids)
        if a >= b:
            return np.zeros(0, np.uint32)
        return unpack(self.raw, self.starts[a // BLOCK : -(-b // BLOCK)])[a % BLOCK :][: b - a]


def write_token_blocks(docs: DataFrame, path: str, end_id: int = 2, files: tuple[str, str] | None = None, file_ids: int = FILE_IDS) -> None:
    """Writes the ids of all documents, each with ``end_id`` after it, in ascending doc_id order into a new folder.

    A null text is an empty one. Rows without doc_id come first, rows of one id stand together, ordered by their text's
    hash. Rows are dealt by ranges of (doc_id, hash, row number), so an id that very many rows share has many tasks. A task writes its
    range into files of about ``file_ids`` ids; a document is in one file, so a longer one makes a larger file.
    """
    files = files or paths()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col("doc_id").cast("long"), "text").withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = (F.col("doc_id").asc_nulls_first(), "hash", "row")
    dealt = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.of(*files), TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        number = before = have = 0
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids.append(doc_id)
                ids.append(np.concatenate([encoder.ids(text.as_py() or ""), end]))
                have += len(ids[-1])
                if have >= file_ids:
                    yield pa.RecordBatch.from_arrays([pa.array([file_bytes(doc_ids, ids, part, number, before)], pa.binary())], ("content",))
                    number, before, have, doc_ids, ids = number + 1, before + have, 0, [], []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([file_bytes(doc_ids, ids, part, number, before)], pa.binary())], ("content",))

    dealt.mapInArrow(run, "content binary").select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", END.decode()).text(path)


def read_token_blocks(spark: SparkSession, path: str, checksums: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents in a folder: how many ids of the folder are before theirs, and these.

    ``checksums``: ids_crc32 instead, of the ids as unsigned 32-bit integers. Only the files' trailers are read to place the
    documents: the ids of a part are added up, and the sums run over a row a part.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content", "length")
    field = lambda k: F.conv(F.concat(*(F.hex(F.substring(F.col("t"), 8 * k + b + 1, 1)) for b in reversed(range(8)))), 16, 10).cast("long")
    trailers = files.select(F.expr(f"substring(content, int(length) - {TRAILER.size}, {TRAILER.size})").alias("t"))
    totals = trailers.groupBy(field(0).alias("part")).agg(F.sum(field(3)).alias("n"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = totals.select("part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("place"))  # a row a part
    name, kind = ("ids_crc32", "long") if checksums else ("ids", "array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                f = TokenFile(memoryview(content.as_buffer()))
                ends = np.cumsum(f.sizes)
                first = 0
                while first < len(ends):  # some documents at a time
                    last = max(int(np.searchsorted(ends, ends[first] + (1 << 18))), first + 1)
                    size = f.sizes[first:last]
                    begin = ends[first:last] - size
                    ids = f.ids(int(begin[0]), int(ends[last - 1]))
                    cuts = np.append(begin - begin[0], len(ids))
                    if checksums:
                        values = pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.int64())
                    else:
                        values = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32)))
                    columns = [pa.array(f.doc_ids[first:last], pa.int64()), pa.array(np.full(last - first, f.part)), pa.array(f.before + begin), pa.array(size), values]
                    yield pa.RecordBatch.from_arrays(columns, ("doc_id", "part", "own", "n_tokens", name))
                    first = last

    rows = files.select("content").mapInArrow(run, f"doc_id long, part long, own long, n_tokens long, {name} {kind}")
    return rows.join(F.broadcast(places), "part").select("doc_id", (F.col("own") + F.col("place")).alias("start"), "n_tokens", name)


def op11_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-blocks-{uuid.uuid4().hex}"
    write_token_blocks(table(spark, sf_dir, "documents"), path)
    return read_token_blocks(spark, path, checksums=True)
