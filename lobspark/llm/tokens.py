"""Encoding with a public byte-level vocabulary, and operator 10: token counts from an exact length histogram."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lobspark.llm.common import checkpointed, table, tokenizer_path

#: The split pattern of this vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters whose classes every regex library agrees on; texts with others go the slower, defining way.
UNUSUAL = re.compile("[^\n\t\r\x20-\x7e¡-ɏ]|<\\|endoftext")


class Encoder:
    """Ids of a text as the vocabulary file defines them, by the faster of two libraries with the same result.

    ``json_path`` and ``ranks_path`` hold one vocabulary; built once in each Python worker.
    """

    _made: dict[tuple[str, str], Encoder] = {}

    def __init__(self, json_path: str, ranks_path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_file(json_path)

    @classmethod
    def of(cls, json_path: str, ranks_path: str) -> Encoder:
        key = (json_path, ranks_path)
        if key not in cls._made:
            cls._made[key] = cls(*key)
        return cls._made[key]

    def ids(self, text: str) -> np.ndarray:
        if UNUSUAL.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)


def paths(name: str = "byte_bpe_50k") -> tuple[str, str]:
    return tokenizer_path(f"{name}.json"), tokenizer_path(f"{name}.tiktoken")


def pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, files: tuple[str, str] | None = None) -> DataFrame:
    """Each document's ids plus ``end_id``, cut into pieces of ``capacity``, the first one perhaps shorter.

    Only a document longer than ``capacity`` is cut. A null text is an empty one: a single ``end_id``.
    Columns: doc_id, piece, start, length, ids_crc32 (of little-endian unsigned 32-bit ids). Ids don't leave the task.
    """
    files = files or paths()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(*files)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encoder.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
                starts = [0, *range(first, len(ids), capacity)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lengths(docs: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """How many documents of the partition's batches have which encoded length: (length, n)."""
    files = files or paths()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(*files)
        for batch in batches:
            n = [len(encoder.ids(t.as_py() or "")) for t in batch.column(0)]
            size, many = np.unique(np.array(n, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(many)], ("length", "n"))

    return docs.select("text").mapInArrow(count, "length long, n long")


def length_histogram(docs: DataFrame, files: tuple[str, str] | None = None, block: int = 1024) -> DataFrame:
    """One row for each encoded length that occurs, with the sums that answer every context limit.

    Columns: length; n_docs of it; n_longer (documents that a limit of ``length`` would cut); n_tokens of these
    documents; tokens_cut (all tokens left if each document were cut at ``length``); share_whole (documents kept whole);
    n_total and tokens_total. A quantile q is the smallest length with ``n_total - n_longer >= q * n_total``.
    A null or empty text has length 0. An empty table gives no rows.

    The suffix sums go in two steps: within blocks of ``block`` lengths, then over the blocks' totals, so that
    no task gets all lengths.
    """
    hist = lengths(docs, files).groupBy("length").agg(F.sum("n").alias("n_docs"))
    hist = hist.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / block).alias("block"))
    hist = checkpointed(hist)
    totals = hist.groupBy("block").agg(F.sum("n_docs").alias("bn"), F.sum("n_tokens").alias("bt"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    totals = totals.select(
        "block",
        F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("n_above"),
        F.coalesce(F.sum("bt").over(above), F.lit(0)).alias("t_above"),
        F.sum("bn").over(every).alias("n_total"),
        F.sum("bt").over(every).alias("tokens_total"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    both = hist.withColumns({"n_in": F.coalesce(F.sum("n_docs").over(inside), F.lit(0)), "t_in": F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))}).join(totals, "block")
    longer = F.col("n_in") + F.col("n_above")
    beyond = F.col("t_in") + F.col("t_above")
    return both.select(
        "length",
        "n_docs",
        longer.alias("n_longer"),
        "n_tokens",
        (F.col("tokens_total") - beyond + longer * F.col("length")).alias("tokens_cut"),
        ((F.col("n_total") - longer) / F.col("n_total")).alias("share_whole"),
        "n_total",
        "tokens_total",
    )


def answer(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Totals for given context limits, from ``length_histogram`` alone: (context, n_docs, n_cut, tokens_kept)."""
    fits = F.col("length") <= F.col("context")
    return (
        histogram.withColumn("context", F.explode(F.array(*(F.lit(int(x)).cast("long") for x in limits))))
        .groupBy("context")
        .agg(
            F.sum("n_docs").alias("n_docs"),
            F.sum(F.when(fits, 0).otherwise(F.col("n_docs"))).alias("n_cut"),
            F.sum(F.when(fits, F.col("n_tokens")).otherwise(F.col("context") * F.col("n_docs"))).alias("tokens_kept"),
        )
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(table(spark, sf_dir, "documents"))
