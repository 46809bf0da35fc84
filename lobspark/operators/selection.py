"""Exact order statistics of keys of any size, without sorting a key's rows in one task.

The range of values that holds the wanted rank is divided into cells; the cell of each value is a monotone function of it,
so counts by cell, summed up before the shuffle, tell in which one the rank lies. That cell's least and largest value are the
next range, until it holds few enough rows to be sorted. A range of doubles shrinks by the number of cells each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lobspark.sources.tables import checkpointed

#: Cells of a range, rows of a key that may be sorted together, and most keys with more (see ``most_sorted``).
CELLS, SORTED, MOST_KEYS = 4096, 10_000, 100_000


def most_sorted(n_rows: int, least: int = SORTED) -> int:
    """As many rows are sorted together that no more than MOST_KEYS keys have more."""
    return max(least, n_rows // MOST_KEYS)


def cell_of(kind: T.DataType) -> Column:
    """The cell of x in the range from lo to hi: 0 for lo, more than 0 for hi."""
    if isinstance(kind, T.IntegralType):
        x, lo, hi = (F.col(c).cast("decimal(20,0)") for c in ("x", "lo", "hi"))
        return F.floor((x - lo) * F.least(F.lit(CELLS), hi - lo + 1).cast("decimal(5,0)") / (hi - lo + 1)).cast("long")
    span = F.col("hi") / 2 - F.col("lo") / 2  # halves: the difference of the largest doubles is no double
    share = (F.col("x") / 2 - F.col("lo") / 2) / F.when(span > 0, span)
    return F.coalesce(F.least(F.floor(share * CELLS), F.lit(CELLS - 1)), (F.col("x") > F.col("lo")).cast("long"))


def order_statistics(df: DataFrame, key: str, x: str, wanted: dict[str, Column], least: int = SORTED) -> DataFrame:
    """(key, and a column for each of ``wanted``): the elements of a key's sorted values at 0-based indices.

    An index is a column that may use ``n``, how many values the key has; one out of range, or NULL, gives NULL. NULL values
    don't count; a key without any has no row. Equal values are all right.
    """
    values = checkpointed(df.where(F.col(x).isNotNull()).select(F.col(key).alias("k"), F.col(x).alias("x")))
    sizes = checkpointed(values.groupBy("k").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")))
    limit = most_sorted(int(sizes.agg(F.sum("n")).first()[0] or 0), least)
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), i.cast("long").alias("rank")) for name, i in wanted.items())))
    now = sizes.select("k", "n", "lo", "hi", each.alias("w")).select("k", "n", "lo", "hi", "w.*").where("rank >= 0 AND rank < n")
    large = checkpointed(now.where((F.col("n") > limit) & (F.col("lo") < F.col("hi"))))
    found, fine = [now.where((F.col("n") <= limit) | (F.col("lo") >= F.col("hi")))], Window.partitionBy("k", "name").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    left = large.count()
    while left:
        inside = values.join(F.broadcast(large), "k").where("x >= lo AND x <= hi")  # at most MOST_KEYS keys
        cells = inside.groupBy("k", "name", "rank", cell_of(values.schema["x"].dataType).alias("cell")).agg(F.count("*").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        run = cells.withColumn("run", F.sum("c").over(fine)).where("rank < run AND rank >= run - c")
        step = checkpointed(run.select("k", F.col("c").alias("n"), "lo", "hi", "name", (F.col("rank") - (F.col("run") - F.col("c"))).alias("rank")))
        done = (F.col("n") <= limit) | (F.col("lo") >= F.col("hi"))
        found.append(step.where(done))
        large = step.where(~done)
        left = large.count()
    ranges = found[0]
    for part in found[1:]:
        ranges = ranges.unionByName(part)
    ranges = checkpointed(ranges)
    one = ranges.where("lo >= hi").select("k", "name", F.col("lo").alias("x"))
    rows = values.join(ranges.where("lo < hi"), "k").where("x >= lo AND x <= hi")
    place = F.row_number().over(Window.partitionBy("k", "name").orderBy("x")) - 1
    picked = rows.withColumn("place", place).where("place = rank").select("k", "name", "x")
    every = one.unionByName(picked).groupBy("k").agg(*(F.max(F.when(F.col("name") == name, F.col("x"))).alias(name) for name in wanted))
    return sizes.select("k").join(every, "k", "left").select(F.col("k").alias(key), *wanted)


def top_sums(df: DataFrame, key: str, x: str, top: Column, of) -> DataFrame:
    """(key, n, top, edge, above): how many values, how many of the largest are asked for (may use ``n``, at most n), the
    smallest of these, and the sum of ``of(value, edge)`` over them. Values equal to the edge count as often as they are among them."""
    values = df.select(F.col(key).alias(key), F.col(x).alias("x")).where("x IS NOT NULL")
    sizes = values.groupBy(key).agg(F.count("*").alias("n")).withColumn("top", F.least(top, F.col("n")).cast("long"))
    edges = order_statistics(values, key, "x", {"edge": F.col("n") - F.least(top, F.col("n"))})
    about = checkpointed(sizes.join(edges, key))
    more = values.join(about, key).where("x > edge").groupBy(key).agg(F.count("*").alias("many"), F.sum(of(F.col("x"), F.col("edge"))).alias("s"))
    rest = (F.col("top") - F.coalesce("many", F.lit(0))) * of(F.col("edge"), F.col("edge"))
    return about.join(more, key, "left").select(key, "n", "top", "edge", (F.coalesce("s", F.lit(0.0)) + rest).alias("above"))
