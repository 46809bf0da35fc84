"""Frames of files of any size, read by byte ranges in parallel.

Where a frame begins is known only by following the lengths from the file's start. A range is followed from every place where
a frame could begin in it: it becomes a function from its first frame's place to the place where the first frame after it
begins, with the number of frames between. Such functions compose, so blocks of ranges are composed in parallel, one pass
over a file's blocks finds where each block truly begins, and each block then its ranges. After that, ranges are read on
their own, with the frames' numbers and offsets known. Neighbours among small ranges are followed as one span, as most of the
work is in a span's first bytes, and divided once its first frame is known.

The bytes come through ``pyarrow.fs``, which reads ranges of local, HDFS and object stores.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobspark.sources.tables import checkpointed

#: Bytes of a range, ranges of a block, and bytes that are followed as one at least.
RANGE_BYTES, BLOCK_RANGES, SPAN_BYTES = 64 << 20, 256, 4 << 20

#: A frame takes at most so many bytes: the first one of a range begins before this place in it, or after the range.
REACH = 2 + 0xFFFF

FRAME_SCHEMA = "path string, seq long, offset long, msg_type string, body binary"
MAP_SCHEMA = "path string, no long, a long, b long, exits array<long>, codes binary, counts binary"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a path as Spark writes it, and the path there."""
    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    return fs.FileSystem.from_uri(quote(uri, safe=":/?=&@+,~") if "://" in uri else uri)


def readable(uri: str) -> bool:
    try:
        store, path = opened(uri)
        return store.get_file_info(path).type == fs.FileType.File
    except (OSError, ValueError, pa.ArrowException):
        return False


def _read(uri: str, a: int, b: int) -> np.ndarray:
    store, path = opened(uri)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_at(b - a, a), np.uint8)


def _jumps(data: np.ndarray, at: int, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """From each of the n places of a piece of a file, the first frame's place at or after its end, and the frames between.

    ``data`` is the piece and two bytes more, if the file has them; ``at`` its place in the file of ``size`` bytes. Where a frame is
    malformed, the place comes as -1. Chains are followed by doubling: after k rounds 2**k frames.
    """
    first = data[:n].astype(np.int64)
    second = np.zeros(n, np.int64)
    second[: len(data) - 1 if len(data) <= n else n] = data[1 : n + 1]
    own = np.arange(n, dtype=np.int64)
    length = first << 8 | second
    to = own + 2 + length
    bad = (length == 0) | (at + to > size)
    to = np.where(bad, -1, to)
    many = np.where(bad, 0, 1).astype(np.int64)
    while True:
        inside = np.flatnonzero((to >= 0) & (to < n))
        if not len(inside):
            break
        via = to[inside]
        many[inside] += many[via]
        to[inside] = to[via]
    return np.where(to < 0, -1, to + at), np.where(to < 0, 0, many)


#: Bytes followed from all places at once, and how few chains are then followed one by one.
PIECE, FEW = 1 << 16, 8


def followed(data: np.ndarray, a: int, b: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The function of the range from a to b: for each entry below REACH and b - a, the exit and the frames between.

    data: the range's bytes and, if there are any, the two after it. Chains that meet at a piece's end are one from there on.
    """
    n = b - a
    head = min(REACH, n)
    exits, counts = _jumps(data[: head + 2], a, head, size)
    at = head
    while at < n:
        ends = np.unique(exits[exits >= 0])
        ends = ends[ends < b]  # beyond the range: done
        if not len(ends):
            break
        end = min(at + PIECE, n)
        to, many = np.empty(len(ends), np.int64), np.empty(len(ends), np.int64)
        if len(ends) > FEW:
            jump, step = _jumps(data[at : end + 2], a + at, end - at, size)
            here = ends < a + end
            to[here], many[here] = jump[ends[here] - a - at], step[ends[here] - a - at]
            to[~here], many[~here] = ends[~here], 0
        else:
            raw = data[at : end + 2].tobytes()
            for i, p in enumerate(ends.tolist()):
                to[i], many[i] = _chain(raw, p - a - at, end - at, a + at, size)
        live = np.flatnonzero((exits >= 0) & (exits < b))
        place = np.searchsorted(ends, exits[live])
        counts[live] += many[place]
        exits[live] = to[place]
        counts[exits < 0] = 0
        at = end
    return exits, counts


def _chain(raw: bytes, p: int, n: int, at: int, size: int) -> tuple[int, int]:
    """One chain's way through a piece, as ``_jumps`` has it."""
    k, more = 0, size - at
    while p < n:
        to = p + 2 + (raw[p] << 8 | raw[p + 1] if p + 1 < len(raw) else 0)
        if to == p + 2 or to > more:
            return -1, 0
        p, k = to, k + 1
    return at + p, k


def _packed(exits: np.ndarray, counts: np.ndarray) -> tuple[list[int], bytes, bytes]:
    distinct, codes = np.unique(exits, return_inverse=True)
    return distinct.tolist(), zlib.compress(codes.astype("<u4").tobytes(), 1), zlib.compress(counts.astype("<i8").tobytes(), 1)


def _applied(now: np.ndarray, count: np.ndarray, row) -> tuple[np.ndarray, np.ndarray]:
    """Places (-1 where malformed) and counts after one more range or block."""
    codes, counts = np.frombuffer(zlib.decompress(row.codes), "<u4"), np.frombuffer(zlib.decompress(row.counts), "<i8")
    here = (now >= row.a) & (now < row.b)
    entry = now[here] - row.a
    now, count = now.copy(), count.copy()
    now[here], count[here] = np.asarray(row.exits, np.int64)[codes[entry]], count[here] + counts[entry]
    return now, count


def ranges_of(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, no, a, b, size) of files (path, length)."""
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / range_bytes)))
    each = files.where("length > 0").select("path", "length", k.alias("no"))
    a = F.col("no") * range_bytes
    return each.select("path", "no", a.alias("a"), F.least(a + range_bytes, "length").alias("b"), F.col("length").alias("size"))


def spread(rows: DataFrame) -> DataFrame:
    """Ranges dealt to a task each, up to four for each core, and beyond these to one for each ``RANGE_BYTES``.

    The number is given, as rows of ranges are so short that Spark would merge all of them into one task.
    """
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("b") - F.col("a")), F.lit(0))).first()
    most = max(4 * rows.sparkSession.sparkContext.defaultParallelism, math.ceil(size / RANGE_BYTES))
    return rows.repartition(max(1, min(n, most)), "path", "no")


def index(files: DataFrame, range_bytes: int = RANGE_BYTES, block_ranges: int = BLOCK_RANGES, span_bytes: int = SPAN_BYTES) -> DataFrame:
    """(path, no, a, b, size, start, first, stop): where the first frame of each range begins and its number in the file, and
    where the range's last frame ends. From a malformed frame on these are -1. Stored in the shared folder.

    A span's function takes some ten thousand bytes, and a group is a block's functions, or a file's blocks.
    """
    each = max(1, span_bytes // range_bytes)
    rows = ranges_of(files, each * range_bytes)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                exits, counts = followed(_read(r["path"], r["a"], min(r["b"] + 2, r["size"])), r["a"], r["b"], r["size"])
                e, c, n = _packed(exits, counts)
                yield pa.RecordBatch.from_pylist([{"path": r["path"], "no": r["no"], "a": r["a"], "b": r["b"], "exits": e, "codes": c, "counts": n}], pa.schema([("path", pa.string()), ("no", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("exits", pa.list_(pa.int64())), ("codes", pa.binary()), ("counts", pa.binary())]))

    maps = checkpointed(spread(rows).mapInArrow(follow, MAP_SCHEMA).withColumn("block", F.floor(F.col("no") / block_ranges)))

    def compose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("no")
        a, b = int(group.a.iloc[0]), int(group.b.iloc[-1])
        now = np.arange(a, min(a + REACH, b), dtype=np.int64)
        count = np.zeros(len(now), np.int64)
        for row in group.itertuples():
            now, count = _applied(now, count, row)
        e, c, n = _packed(now, count)
        return pd.DataFrame({"path": [group.path.iloc[0]], "no": [int(group.block.iloc[0])], "a": [a], "b": [b], "exits": [e], "codes": [c], "counts": [n]})

    def entered(group: pd.DataFrame) -> pd.DataFrame:
        """Where each row is truly entered, from one entry: (path, no, start, first)."""
        group = group.sort_values("no")
        now, count = np.array([int(group.entry.iloc[0])], np.int64), np.array([int(group.many.iloc[0])], np.int64)
        starts, firsts = [], []
        for row in group.itertuples():
            starts.append(int(now[0]))
            firsts.append(int(count[0]))
            now, count = _applied(now, count, row)
        return pd.DataFrame({"path": group.path, "no": group.no, "start": starts, "first": firsts, "exit": [*starts[1:], int(now[0])]})

    entries = "path string, no long, start long, first long, exit long"
    blocks = maps.groupBy("path", "block").applyInPandas(compose, MAP_SCHEMA)
    zero = F.lit(0).cast("long")
    of_blocks = blocks.withColumns({"entry": zero, "many": zero}).groupBy("path").applyInPandas(entered, entries)
    into = of_blocks.select("path", F.col("no").alias("block"), F.col("start").alias("entry"), F.col("first").alias("many"))
    found = maps.join(into, ["path", "block"]).groupBy("path", "block").applyInPandas(entered, entries)
    spans = checkpointed(rows.join(found, ["path", "no"]).select("path", "no", "a", "b", "size", "start", "first", F.col("exit").alias("stop")))
    return spans if each == 1 else checkpointed(divided(spans, range_bytes, each))


def divided(spans: DataFrame, range_bytes: int, each: int) -> DataFrame:
    """The same columns for the ranges of spans of ``each`` ranges; a span is read once more, from its first frame on."""
    names = ("path", "no", "a", "b", "size", "start", "first", "stop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                p, n, rows = s["start"], s["first"], []
                raw = _read(s["path"], p, min(s["b"] + 2, s["size"])).tobytes() if 0 <= p < s["b"] else b""
                for k, a in enumerate(range(s["a"], s["b"], range_bytes)):
                    b = min(a + range_bytes, s["b"])
                    to, many = _chain(raw, p - s["start"], b - s["start"], s["start"], s["size"]) if 0 <= p < b else (p, 0)
                    rows.append((s["path"], s["no"] * each + k, a, b, s["size"], p, n, to))
                    p, n = to, n + many
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if name != "path" else pa.string()) for name, c in zip(names, zip(*rows, strict=True), strict=True)], names)

    return spread(spans).mapInArrow(run, "path string, " + ", ".join(f"{name} long" for name in names[1:]))


def starts_of(raw: bytes, p: int, end: int) -> np.ndarray:
    out = []
    while p < end:
        out.append(p)
        p += 2 + (raw[p] << 8 | raw[p + 1])
    return np.array(out, np.int64)


def malformed(raw: bytes, left: int) -> tuple[int, str]:
    """The place of the first malformed frame in a piece after which the file ends in ``left`` bytes, and what is wrong."""
    p = 0
    while True:
        if p + 2 > left:
            return p, "truncated length"
        n = raw[p] << 8 | raw[p + 1]
        if n == 0:
            return p, "zero length"
        if p + 2 + n > left:
            return p, "length past the end"
        p += 2 + n


def frames_of(indexed: DataFrame, at_once: int = 50_000) -> DataFrame:
    """The frames of the ranges of ``index``, each range in a task of its own or with others; a malformed file raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["start"] < 0:
                    continue  # an earlier range raises
                if r["stop"] < 0:
                    data = _read(r["path"], r["start"], min(r["b"] + 2, r["size"])).tobytes()
                    at, what = malformed(data, r["size"] - r["start"])
                    raise ValueError(f"{r['path']}: {what} at offset {r['start'] + at}")
                if r["start"] >= r["b"]:
                    continue  # a frame goes over the whole range
                data = _read(r["path"], r["start"], r["stop"])
                at = starts_of(data.tobytes(), 0, len(data))
                ends = np.append(at[1:], len(data))
                for k in range(0, len(at), at_once):
                    a, b = at[k : k + at_once] + 2, ends[k : k + at_once]
                    size = b - a
                    flat = data[np.repeat(a - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
                    offsets = np.append(0, np.cumsum(size)).astype(np.int32)
                    body = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
                    kinds = pa.array([chr(c) for c in data[a].tolist()])
                    n = len(a)
                    yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * n), pa.array(np.arange(r["first"] + k, r["first"] + k + n)), pa.array(r["start"] + a - 2), kinds, body], ["path", "seq", "offset", "msg_type", "body"])

    return spread(indexed).mapInArrow(run, FRAME_SCHEMA)
