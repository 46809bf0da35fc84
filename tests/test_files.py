"""Frames by ranges against whole files, and writes that are there once or not at all."""

import os
import random
import subprocess
import sys
import textwrap
import time

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from lobspark.sources import frames, ranges, sinks

RNG = random.Random(4)


def capture(n, longest=60):
    out = []
    for _ in range(n):
        size = longest if RNG.random() < 0.02 else RNG.randint(1, 45)
        out.append(size.to_bytes(2, "big") + bytes(RNG.choices(b"\0\0\1AF", k=size)))
    return b"".join(out)


@pytest.mark.parametrize("range_bytes", [700, 5_000, 1 << 20])
def test_ranges_give_the_frames_of_whole_files(spark, tmp_path, range_bytes):
    for name, raw in (("a.bin", capture(3000)), ("b.bin", capture(40, 65_535)), ("c.bin", b""), ("d e.bin", b"\0\1S")):
        (tmp_path / name).write_bytes(raw)
    path = str(tmp_path)
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    got = ranges.frames_of(ranges.index(files, range_bytes, 5), 1000).select("path", "seq", "offset", "msg_type", "body")
    want = frames.read_whole_frames(spark, path)
    assert got.count() == want.count() == 3041
    assert not got.exceptAll(want).count()
    assert ranges.ranges_of(files, 700).count() > 100


@pytest.mark.parametrize("span_bytes", [700, 2_800, 100_000])
def test_small_ranges_are_divided_from_spans_and_read_by_many_tasks(spark, tmp_path, span_bytes):
    for name, raw in (("a.bin", capture(3000)), ("b.bin", capture(40, 65_535)), ("c.bin", b"\0\1S")):
        (tmp_path / name).write_bytes(raw)
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length")
    indexed = ranges.index(files, 700, 5, span_bytes)
    assert sorted(tuple(r) for r in indexed.select("path", "no", "a", "b", "size").collect()) == sorted(tuple(r) for r in ranges.ranges_of(files, 700).collect())
    got = ranges.frames_of(indexed)
    assert got.select(F.spark_partition_id()).distinct().count() > 4
    got, want = got.select("path", "seq", "offset", "msg_type", "body"), frames.read_whole_frames(spark, str(tmp_path))
    assert got.count() == want.count() == 3041 and not got.exceptAll(want).count()


@pytest.mark.parametrize("tail,what", [(b"\0\0\0\1A", "zero length"), (b"\0", "truncated length"), (b"\0\x09abc", "length past the end"), (b"\xff\xffab", "length past the end")])
def test_malformed_files_raise_with_the_place(spark, tmp_path, tail, what):
    raw = capture(2000)
    (tmp_path / "x.bin").write_bytes(raw + tail)
    with pytest.raises(PythonException, match=f"{what} at offset {len(raw)}"):
        frames.read_frames(spark, str(tmp_path), range_bytes=4000).count()


def test_range_functions_against_single_steps():
    raw = capture(4000, 3000)
    data = np.frombuffer(raw, np.uint8)

    def chain(p, b):
        n = 0
        while p < b:
            size = int.from_bytes(raw[p : p + 2], "big") if p + 2 <= len(raw) else 0
            if not size or p + 2 + size > len(raw):
                return -1, 0
            p, n = p + 2 + size, n + 1
        return p, n

    for a, b in ((0, len(raw)), (333, 70_000), (90_000, len(raw)), (len(raw) - 40, len(raw))):
        exits, counts = ranges.followed(data[a : b + 2], a, b, len(raw))
        assert len(exits) == min(b - a, ranges.REACH)
        for e in RNG.sample(range(len(exits)), min(len(exits), 400)):
            assert (exits[e], counts[e]) == chain(a + e, b)


def test_guard_of_range_reading(spark, tmp_path):
    (tmp_path / "20181228.bin").write_bytes(b"\0\1S")
    with pytest.raises(Exception, match="split guard"):
        frames.read_frames(spark, str(tmp_path)).count()
    assert frames.read_frames(spark, str(tmp_path), allow_test=True).count() == 1


def messages(spark, n):
    return spark.range(n).selectExpr("concat('dir/s', id % 3) AS path", "id AS seq", "1 AS locate", "id AS ts_ns", "'D' AS msg_type", "id * 7 AS order_ref")


@pytest.mark.parametrize("parts", [None, 5])
def test_written_frames_come_back(spark, tmp_path, parts):
    path = str(tmp_path / "out")
    counts = {r.file: r.frames for r in frames.write_frames(messages(spark, 900).repartition(4), path, parts=parts).collect()}
    assert sum(counts.values()) == 900 and set(counts) == set(os.listdir(path))
    assert len(counts) == 3 if not parts else 5 <= len(counts) <= 7
    back = frames.messages(frames.read_frames(spark, path, range_bytes=500))
    rows = sorted((r.path.rsplit("/", 1)[1], r.seq, r.order_ref) for r in back.collect())
    streams = {}
    for file, _, ref in rows:
        streams.setdefault(file.split(".")[0], []).append(ref)
    assert streams == {f"s{k}": [i * 7 for i in range(900) if i % 3 == k] for k in range(3)}


def test_written_tokens_come_back(spark, tmp_path):
    path, ids = str(tmp_path / "out"), {"SPY": [1, 3, *range(400), 4, 2], "X": [], "LONGNAME": [65_535]}
    rows = [(s, i, t) for s, ts in ids.items() for i, t in enumerate(ts)] + [("X", 0, None)]
    frames.write_tokens(spark.createDataFrame(rows, "symbol string, place long, token long").repartition(3), path, at_once=64)
    assert {r.ticker: r.tokens for r in frames.read_tokens(spark, path).collect()} == ids
    with open(f"{path}/SPY.oftk", "rb") as f:
        assert f.read() == frames.token_file("SPY", np.array(ids["SPY"]))


def test_a_long_token_file_is_read_in_time_by_its_length(spark, tmp_path):
    ids = [k % 65_536 for k in range(150_000)]
    (tmp_path / "a.oftk").write_bytes(frames.token_file("SPY", ids))
    (tmp_path / "b.oftk").write_bytes(frames.token_file("X", []))
    began = time.monotonic()
    assert {r.ticker: r.tokens for r in frames.read_tokens(spark, str(tmp_path)).collect()} == {"SPY": ids, "X": []}
    for at_once in (4096, 150_000, 149_999):
        rows = frames.read_token_rows(spark, str(tmp_path), at_once).collect()
        assert [(r.ticker, r.place, r.token) for r in sorted(rows, key=lambda r: r.place)] == [("SPY", k, t) for k, t in enumerate(ids)]
    assert time.monotonic() - began < 30  # minutes where each id looks through the file
    for bad in (frames.token_file("Y", [1])[:-1], b"OFTX" + frames.token_file("Y", [])[4:], b"OF"):
        (tmp_path / "b.oftk").write_bytes(bad)
        with pytest.raises(Exception, match="not a token file"):
            frames.read_token_rows(spark, str(tmp_path)).count()


def test_tokens_are_made_once_for_a_write(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(500).selectExpr("concat('S', id % 2) AS symbol", "id div 2 AS place", "id AS token")
    frames.write_tokens(rows.mapInArrow(counted, "symbol string, place long, token long"), str(tmp_path / "out"))
    assert made.value == 500 and sorted(os.listdir(tmp_path / "out")) == ["S0.oftk", "S1.oftk"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    good = spark.range(100).select(F.lit("a").alias("file"), F.lit(b"xy").alias("content"))
    bad = good.withColumn("content", F.when(F.spark_partition_id() == 3, F.raise_error(F.lit("boom")).cast("binary")).otherwise(F.col("content")))
    for rows in (bad.withColumn("file", F.concat("file", F.spark_partition_id())).repartition(4), good.repartition(4)):  # the second: one file in four tasks
        with pytest.raises(Exception):
            sinks.write_bytes(rows, path)
        assert not os.path.exists(path) or os.listdir(path) == []
    sinks.write_bytes(good.coalesce(1), path)
    sinks.write_bytes(good.coalesce(1).withColumn("file", F.lit("b")), path)
    assert sorted(os.listdir(path)) == ["a", "b"]
    sinks.write_bytes(good.coalesce(1).withColumn("file", F.lit("c")), path, overwrite=True)
    assert os.listdir(path) == ["c"] and os.path.getsize(f"{path}/c") == 200


def test_a_retried_task_leaves_one_copy(tmp_path):
    """In a session of its own, whose tasks may fail twice."""
    program = f"""
    from pyspark.sql import SparkSession, functions as F
    from pyspark import TaskContext
    from lobspark.sources import sinks
    spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()

    def rows(batches):
        import pyarrow as pa
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().attemptNumber()
        for k in range(3):
            if attempt < 2 and part == 1 and k == 2:
                raise ValueError("this attempt fails after some bytes")
            yield pa.RecordBatch.from_pydict({{"file": [f"f{{part}}"] * 1000, "content": [bytes([65 + part])] * 1000}})

    sinks.write_bytes(spark.range(0, 4, 1, 2).mapInArrow(rows, "file string, content binary"), {str(tmp_path / "out")!r})
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", textwrap.dedent(program)], check=True, timeout=120, env=os.environ | {"PYTHONPATH": root}, capture_output=True)
    assert sorted(os.listdir(tmp_path / "out")) == ["f0", "f1"]
    assert (tmp_path / "out/f0").read_bytes() == b"A" * 3000 and (tmp_path / "out/f1").read_bytes() == b"B" * 3000
