"""Framed binary order messages as a Spark data source, with pure column decoding.

A file is a sequence of frames, each a two-byte big-endian length and a body whose first byte is the message's type. The
source yields raw frames; fields are cut out of the body by column expressions, so that Spark plans them like any
other projection. A file's order is the total order of its messages; files are read by ranges, see ``ranges``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lobspark.functions.scalars import BODY_LENGTH
from lobspark.sources import ranges, sinks
from lobspark.sources.splits import guarded
from lobspark.sources.tables import checkpointed

#: Where a field's bytes stand in a body, by type (fixed values of the wire format): offset and length.
FIELDS = {
    "locate": {t: (1, 2) for t in "AFECXDUR"},
    "tracking": {t: (3, 2) for t in "AFECXDUR"},
    "ts_ns": {t: (5, 6) for t in "AFECXDUR"},
    "order_ref": {t: (11, 8) for t in "AFECXDU"},
    "new_ref": {"U": (19, 8)},
    "shares": {"A": (20, 4), "F": (20, 4), "E": (19, 4), "C": (19, 4), "X": (19, 4), "U": (27, 4)},
    "price": {"A": (32, 4), "F": (32, 4), "C": (32, 4), "U": (31, 4)},
    "match_num": {"E": (23, 8), "C": (23, 8)},
    "round_lot": {"R": (21, 4)},
}
TEXTS = {"side": {"A": (19, 1), "F": (19, 1)}, "printable": {"C": (31, 1)}, "stock": {"A": (24, 8), "F": (24, 8), "R": (11, 8)}, "mpid": {"F": (36, 4)}}
LENGTHS = {**BODY_LENGTH, "R": 39}
FRAME_SCHEMA = "path string, seq long, offset long, msg_type string, body binary"


def split_frames(raw: bytes) -> tuple[list[tuple[int, bytes]], str | None]:
    """The frames of a file as (offset, body), and what is wrong with it, if anything: framing errors are fatal there."""
    out, at = [], 0
    while at < len(raw):
        if at + 2 > len(raw):
            return out, "truncated length"
        n = int.from_bytes(raw[at : at + 2], "big")
        if n == 0:
            return out, "zero length"
        if at + 2 + n > len(raw):
            return out, "length past the end"
        out.append((at, raw[at + 2 : at + 2 + n]))
        at += 2 + n
    return out, None


def read_frames(spark: SparkSession, path: str, allow_test: bool = False, range_bytes: int = ranges.RANGE_BYTES) -> DataFrame:
    """(path, seq, offset, msg_type, body) of all frames; a malformed file raises with the place.

    Files of any size are read by ranges (see ``ranges``) where the store can be read so; others a file a task, see
    ``read_whole_frames``. The split guard refuses files of test days unless they are asked for.
    """
    files = guarded(spark.read.format("binaryFile").load(path).select("path", "length"), allow_test)
    first = files.select("path").first()
    if first and not ranges.readable(first.path):
        return read_whole_frames(spark, path, allow_test)
    return ranges.frames_of(ranges.index(files, range_bytes))


def read_whole_frames(spark: SparkSession, path: str, allow_test: bool = False) -> DataFrame:
    """The same from any store that Spark reads, a file of at most 2 GB a task."""
    files = guarded(spark.read.format("binaryFile").load(path).select("path", "content"), allow_test)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                frames, wrong = split_frames(content.as_py())
                if wrong:
                    raise ValueError(f"{name}: {wrong} after frame {len(frames)}")
                for k in range(0, len(frames), 50_000):
                    part = frames[k : k + 50_000]
                    columns = [[name] * len(part), range(k, k + len(part)), [o for o, _ in part], [chr(b[0]) for _, b in part], [b for _, b in part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], ("path", "seq", "offset", "msg_type", "body"))

    return files.mapInArrow(run, FRAME_SCHEMA)


def unsigned(body: Column, offset: int, length: int) -> Column:
    """Big-endian integer at an offset; eight-byte ones keep their bits in a signed column (only equality matters)."""
    part = F.hex(F.substring(body, offset + 1, length))
    if length < 8:
        return F.conv(part, 16, 10).cast("long")
    high, low = F.conv(F.substring(part, 1, 8), 16, 10).cast("long"), F.conv(F.substring(part, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def decode(frames: DataFrame) -> DataFrame:
    """Frames with a column for each field and ``decode_error``: NULL, or why the body is no message of its type."""
    t, body = F.col("msg_type"), F.col("body")

    def pick(by_type: dict, make) -> Column:
        out = F.lit(None)
        for place in sorted(set(by_type.values())):
            out = F.when(t.isin([k for k, v in by_type.items() if v == place]), make(*place)).otherwise(out)
        return out

    right = F.lit(False)
    for k, n in LENGTHS.items():
        right = F.when(t == k, F.length(body) == n).otherwise(right)
    columns = {k: F.when(right, pick(v, lambda o, n: unsigned(body, o, n))).cast("long") for k, v in FIELDS.items()}
    columns |= {k: F.when(right, F.rtrim(pick(v, lambda o, n: F.decode(F.substring(body, o + 1, n), "ISO-8859-1")))) for k, v in TEXTS.items()}
    out = frames.withColumns(columns)
    wrong = F.when(~t.isin(list(LENGTHS)), "unknown type").when(~right, "wrong length").when(t.isin("A", "F") & ~F.col("side").isin("B", "S"), "bad side").when((t == "C") & ~F.col("printable").isin("Y", "N"), "bad printable")
    return out.withColumn("decode_error", wrong)


def messages(frames: DataFrame) -> DataFrame:
    """The order messages of decoded frames; frames of other types are skipped, undecodable ones raise."""
    d = decode(frames).where(F.col("msg_type").isin(list(BODY_LENGTH)))
    checked = F.when(F.col("decode_error").isNotNull(), F.raise_error(F.concat_ws(" ", "path", "seq", "decode_error"))).otherwise(F.col("seq"))
    names = ("locate", "tracking", "ts_ns", "msg_type", "order_ref", "new_ref", "side", "shares", "price", "match_num", "printable", "stock", "mpid")
    return d.select("path", checked.cast("long").alias("seq"), *names)


def directory(frames: DataFrame) -> DataFrame:
    """(locate, stock, round_lot): the instruments' dimension, from the directory frames of the same files."""
    return decode(frames.where("msg_type = 'R'")).where("decode_error IS NULL").select("locate", "stock", "round_lot")


def locates(directory: DataFrame, tickers: list[str]) -> DataFrame:
    """(ticker, locate) of a panel of tickers, given with or without the padding of the wire; NULL for an unknown one."""
    wanted = directory.sparkSession.createDataFrame([(t.rstrip(),) for t in tickers], "ticker string").distinct()
    return wanted.join(directory.select(F.rtrim("stock").alias("ticker"), "locate"), "ticker", "left")


def of_panel(msgs: DataFrame, directory: DataFrame, tickers: list[str]) -> DataFrame:
    """The messages of a panel's instruments, with nothing else changed."""
    return msgs.join(F.broadcast(locates(directory, tickers).select("locate").distinct()), "locate", "left_semi")  # as many rows as tickers


def prefix(msgs: DataFrame, n: int) -> DataFrame:
    """The first ``n`` decoded messages of each file, by their place there."""
    place = F.row_number().over(Window.partitionBy("path").orderBy("seq"))
    return msgs.withColumn("place", place).where(F.col("place") <= n).drop("place")


def skipped(frames: DataFrame) -> DataFrame:
    """(msg_type, n): frames that are no order messages."""
    return frames.where(~F.col("msg_type").isin(list(BODY_LENGTH))).groupBy("msg_type").agg(F.count("*").alias("n"))


def encode(msgs: DataFrame) -> DataFrame:
    """``msgs`` with ``body``: the message's bytes, from columns alone (the inverse of ``decode``)."""
    big = lambda c, n: F.unhex(F.lpad(F.substring(F.hex(F.coalesce(c.cast("long"), F.lit(0))), -2 * n, 2 * n), 2 * n, "0"))
    text = lambda c, n: F.encode(F.rpad(F.coalesce(c, F.lit("")), n, " "), "ISO-8859-1")
    t = F.col("msg_type")
    body = F.lit(None).cast("binary")
    for kind, total in LENGTHS.items():
        places = {by[kind]: (name, big) for name, by in FIELDS.items() if kind in by} | {by[kind]: (name, text) for name, by in TEXTS.items() if kind in by}
        parts, at = [F.encode(F.lit(kind), "ISO-8859-1")], 1
        for (o, n), (name, make) in sorted(places.items(), key=lambda x: x[0]):
            if o > at:
                parts.append(F.unhex(F.lit("20" * (o - at))))
            parts.append(make(F.col(name) if name in msgs.columns else F.lit(None).cast("string" if make is text else "long"), n))
            at = o + n
        if at < total:
            parts.append(F.unhex(F.lit("20" * (total - at))))
        body = F.when(t == kind, F.concat(*parts)).otherwise(body)
    return msgs.withColumn("body", body)


def write_frames(msgs: DataFrame, path: str, by: str = "path", order: str = "seq", parts: int | None = None) -> DataFrame:
    """Writes the frames of each value of ``by``, in order, to a file named by its last part; returns (file, frames).

    A file is totally ordered, so one task writes it. parts: instead, all streams together are dealt into so many ranges, and
    a task writes its range of a stream to a file with the range's number after the name; in that order they are the stream.
    The write is all or nothing, see ``sinks``.
    """
    name = F.element_at(F.split(F.col(by).cast("string"), "/"), -1)
    framed = encode(msgs).select(name.alias("file"), order, "body")
    if parts:
        framed = framed.repartitionByRange(parts, "file", order).withColumn("file", F.concat_ws(".", "file", F.lpad(F.spark_partition_id().cast("string"), 6, "0")))
    else:
        framed = framed.repartition(F.xxhash64("file"))
    content = F.concat(F.unhex(F.lpad(F.hex(F.octet_length("body").cast("long")), 4, "0")), "body")
    sinks.write_bytes(framed.sortWithinPartitions("file", order).select("file", content.alias("content")), path)
    return framed.groupBy("file").agg(F.count("*").alias("frames"))


def write_tokens(tokens: DataFrame, path: str, at_once: int = 4096) -> None:
    """Writes a token file for each symbol of (symbol, place, token), named by it: magic, version 2, symbol, count, then
    little-endian 16-bit ids in the order of their places. Ids go to the files in runs of ``at_once``, which are stored once for
    the counts and the files."""
    little = lambda c, n: F.concat(*(F.unhex(F.lpad(F.hex(F.shiftright(c.cast("long"), 8 * k).bitwiseAND(255)), 2, "0")) for k in range(n)))
    name = F.col("symbol").cast("string")
    runs = tokens.groupBy(name.alias("name"), F.floor(F.col("place") / at_once).alias("run")).agg(F.count("token").alias("n"), F.sort_array(F.collect_list(F.struct("place", "token"))).alias("t"))
    hexed = F.transform("t", lambda t: F.concat(*(F.lpad(F.hex(F.shiftright(t["token"].cast("long"), 8 * k).bitwiseAND(255)), 2, "0") for k in range(2))))
    body = checkpointed(runs.select("name", "run", "n", F.unhex(F.array_join(hexed, "")).alias("content")))
    counts = body.groupBy("name").agg(F.sum("n").alias("n"))
    head = F.concat(F.encode(F.concat(F.lit("OFTK"), F.lit("\2\0\0\0"), F.rpad("name", 12, "\0")), "ISO-8859-1"), little(F.col("n"), 8))
    heads = counts.select("name", F.lit(-1).cast("long").alias("run"), head.alias("content"))
    body = body.drop("n")
    rows = heads.unionByName(body).repartition(F.xxhash64("name")).sortWithinPartitions("name", "run")
    sinks.write_bytes(rows.select(F.concat("name", F.lit(".oftk")).alias("file"), "content"), path)


def token_file(ticker: str, tokens: np.ndarray) -> bytes:
    """A token file: magic, version 2, ticker, count, then little-endian 16-bit ids."""
    return b"OFTK" + (2).to_bytes(4, "little") + ticker.encode().ljust(12, b"\0") + len(tokens).to_bytes(8, "little") + np.asarray(tokens, "<u2").tobytes()


def _token_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, ticker, n, content) of token files; a wrong magic, version or length raises."""
    c = F.col("content")
    n = _little(c, 20, 8)
    fine = (F.substring(c, 1, 4) == F.lit(b"OFTK")) & (_little(c, 4, 4) == 2) & (F.length(c) == 28 + 2 * n)
    ticker = F.regexp_replace(F.decode(F.substring(c, 9, 12), "ISO-8859-1"), "\\x00+$", "")
    checked = F.when(fine, n).otherwise(F.raise_error(F.concat(F.lit("not a token file: "), F.col("path"))))
    return spark.read.format("binaryFile").load(path).select("path", ticker.alias("ticker"), checked.cast("long").alias("n"), "content")


def _little(c: Column, at: Column | int, n: int) -> Column:
    """Little-endian integer of some bytes."""
    return F.conv(F.hex(F.concat(*(F.substring(c, at + k + 1, 1) for k in reversed(range(n))))), 16, 10).cast("long")


def _ids(piece: Column) -> Column:
    """The 16-bit ids in some bytes, as an array. For a lambda's variable: a row's column is copied whole for each id."""
    return F.transform(F.sequence(F.lit(0), (F.length(piece) / 2).cast("int") - 1), lambda k: _little(piece, 2 * k, 2))


def _pieces(at_once: int) -> Column:
    """The ids' bytes of a token file that has some, in runs of ``at_once``."""
    runs = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / at_once))
    return F.transform(runs, lambda r: F.substring(F.col("content"), (29 + 2 * at_once * r).cast("int"), F.lit(2 * at_once)))


def read_tokens(spark: SparkSession, path: str, at_once: int = 4096) -> DataFrame:
    """(path, ticker, n, tokens) of token files; a wrong magic, version or length raises."""
    ids = F.when(F.col("n") > 0, F.flatten(F.transform(_pieces(at_once), _ids))).otherwise(F.array().cast("array<long>"))
    return _token_files(spark, path).select("path", "ticker", "n", ids.alias("tokens"))


def read_token_rows(spark: SparkSession, path: str, at_once: int = 4096) -> DataFrame:
    """(path, ticker, place, token): the same as a row a token. A file is first cut into runs of ``at_once`` ids."""
    pieces = _token_files(spark, path).where("n > 0").select("path", "ticker", F.posexplode(_pieces(at_once)).alias("run", "piece"))
    rows = pieces.select("path", "ticker", "run", F.posexplode(F.transform(F.array("piece"), _ids)[0]).alias("k", "token"))
    return rows.select("path", "ticker", (F.col("run").cast("long") * at_once + F.col("k")).alias("place"), "token")
