"""Running sums over the order of a whole stream, or of one huge key, with no task that has more than its range of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lobspark.sources.tables import checkpointed


def running(df: DataFrame, order: list[str], sums: dict[str, Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with, for each of ``sums``, its sum over all rows up to and with this one, within ``keys``; NULL terms are 0.

    ``order`` must tell all rows of a key apart. Rows are dealt by ranges of (keys, order), so a key may have any share of
    them, and are stored with their range. A window runs over a range, the totals of the ranges before are added: these are a
    row for each range and key in it, so at most as many as ranges and keys together.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    terms = {f"_{name}": F.coalesce(x, F.lit(0)) for name, x in sums.items()}
    dealt = checkpointed(df.withColumns(terms).repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy(*keys, "_range").agg(*(F.sum(f"_{name}").alias(f"_total_{name}") for name in sums))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.col("_range").alias("_at"), *(F.coalesce(F.sum(f"_total_{name}").over(before), F.lit(0)).alias(f"_base_{name}") for name in sums))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumns({f"_{name}": F.sum(f"_{name}").over(inside) for name in sums})
    same = F.col("_range") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    both = own.join(bases if keys else F.broadcast(bases), same)  # without keys a row for each range
    return both.select(*df.columns, *((F.col(f"_{name}") + F.col(f"_base_{name}")).alias(name) for name in sums))


def numbered(df: DataFrame, order: list[str], name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with each row's place, from 1, in its key's order."""
    return running(df, order, {name: F.lit(1)}, keys)


def peaks(replayed: DataFrame) -> DataFrame:
    """One row: messages, books touched, and the most orders open at once in all books, after any accepted message.

    replayed: (locate, us, seq, result, open_orders), a row a message, seq in the order of the whole stream.
    """
    w = Window.partitionBy("locate").orderBy("us", "seq")
    change = F.col("open_orders") - F.coalesce(F.lag("open_orders").over(w), F.lit(0))
    changes = replayed.select("locate", "us", "seq", "result", change.alias("change"))
    whole = running(changes, ["us", "seq"], {"open": F.col("change")})
    return whole.agg(F.count("*").alias("messages"), F.countDistinct("locate").alias("books_touched"), F.max(F.when(F.col("result") == "Ok", F.col("open"))).alias("peak_open_total"))
