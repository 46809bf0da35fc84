"""Series by symbol: returns, tick series, calendar grids, exact order statistics, sign decisions.

Input frames are (symbol, i, ts, mid) with i from 1 in time order, or (symbol, ts, seq, sign, shares) for fills. Prices are
numbered by ranges and compared within blocks of their numbers, so that no task holds a symbol's whole series; the
windows over fills partition by symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lobspark.operators import scan
from lobspark.operators.selection import order_statistics

#: Neighbouring values of a series that a window sees at once.
BLOCK = 50_000


def by(*cols: str):
    return Window.partitionBy(*cols)


def ordered(df: DataFrame, *order: str, key: str = "symbol") -> DataFrame:
    """``df`` with ``i``: the place, from 1, in a key's order; see ``scan``."""
    return scan.numbered(df, list(order), "i", (key,))


def with_last(series: DataFrame, block: int = BLOCK) -> DataFrame:
    """``series`` with ``last``: the mid before. i must number a symbol's values without holes.

    A window has a block of a symbol's numbers, and the last value of the block before.
    """
    own = F.floor((F.col("i") - 1) / block)
    each = F.when(F.col("i") % block == 0, F.array(own, own + 1)).otherwise(F.array(own))
    w = by("symbol", "_block").orderBy("i")
    dealt = series.withColumn("_own", own).withColumn("_block", F.explode(each))
    return dealt.withColumn("last", F.lag("mid").over(w)).where("_own = _block").drop("_own", "_block")


def tick_series(series: DataFrame) -> DataFrame:
    """Only the observations where the mid changed, numbered anew."""
    return ordered(with_last(series).where("last IS NULL OR mid <> last").drop("last", "i"), "ts", "seq")


def log_returns(series: DataFrame) -> DataFrame:
    """(symbol, i, r); the first observation has none."""
    return with_last(series).select("symbol", "i", F.log(F.col("mid") / F.col("last")).alias("r")).where("r IS NOT NULL")


def locf_grid(series: DataFrame, step: int) -> DataFrame:
    """The last mid at ``ts <= t`` on the multiples of ``step`` from a symbol's first observation to its last.

    The last observation up to each grid point and after the one before is found by an aggregate; a window fills the points
    that have none, over a row a point.
    """
    ends = series.groupBy("symbol").agg(F.ceil(F.min("ts") / step).alias("a"), F.floor(F.max("ts") / step).alias("b")).where("a <= b")
    points = ends.select("symbol", F.explode(F.transform(F.sequence("a", "b"), lambda k: k * step)).alias("ts")).select("symbol", "ts", F.lit(1).alias("grid"), F.lit(None).cast("double").alias("mid"))
    at = (F.ceil(F.col("ts") / step) * step).alias("ts")
    seen = series.where("mid IS NOT NULL").groupBy("symbol", at).agg(F.max_by("mid", F.struct("ts", "seq")).alias("mid"))
    both = seen.select("symbol", "ts", F.lit(0).alias("grid"), "mid").unionByName(points)
    carried = F.last("mid", ignorenulls=True).over(by("symbol").orderBy("ts", "grid"))
    return both.withColumn("mid", carried).where("grid = 1").drop("grid").withColumn("i", F.row_number().over(by("symbol").orderBy("ts")).cast("long"))


def order_statistic(df: DataFrame, key: str, x: str, index: Column, name: str) -> DataFrame:
    """(key, name): the element of the sorted values at a 0-based index that may use ``n``; keys without one are left out."""
    return order_statistics(df, key, x, {name: index}).where(F.col(name).isNotNull())


def upper_median(df: DataFrame, key: str, x: str, name: str) -> DataFrame:
    return order_statistic(df, key, x, F.floor(F.col("n") / 2), name)


def weighted_percentile(histogram: DataFrame, key: str, value: str, count: str, p: float) -> DataFrame:
    """Over a histogram: the first value whose running count exceeds floor(p (n - 1))."""
    run = F.sum(count).over(by(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    marked = histogram.withColumns({"run": run, "n": F.sum(count).over(by(key))})
    return marked.where(F.col("run") > F.floor(p * (F.col("n") - 1))).groupBy(key).agg(F.min(value).alias("value"))


def decisions(fills: DataFrame, window: int) -> DataFrame:
    """Fills of one sign in gaps of at most ``window`` are one decision: (symbol, decision, sign, ts, fills, shares).

    Every fill moves the anchor, so a chain may last longer than the window. Fills of the other sign end it.
    """
    w = by("symbol").orderBy("ts", "seq")
    new = (F.lag("sign").over(w).isNull() | (F.lag("sign").over(w) != F.col("sign")) | (F.col("ts") - F.lag("ts").over(w) > window)).cast("long")
    numbered = fills.withColumn("new", new).withColumn("decision", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("symbol", "decision").agg(F.first("sign").alias("sign"), F.min("ts").alias("ts"), F.count("*").alias("fills"), F.sum("shares").alias("shares"))


def longest_run(df: DataFrame, key: str, order: str, flag: Column) -> DataFrame:
    """(key, longest): the most consecutive rows with the flag, by gaps and islands."""
    w = by(key).orderBy(order)
    marked = df.select(key, order, flag.alias("flag")).withColumn("island", F.row_number().over(w) - F.sum(F.col("flag").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(key, "island").agg(F.sum(F.col("flag").cast("long")).alias("n"))
    return runs.groupBy(key).agg(F.max("n").alias("longest"))


def backward_asof(left: DataFrame, right: DataFrame, key: str, values: list[str], strict: bool) -> DataFrame:
    """Each left row (key, t) with the last right row (key, t, order) at or (strict) before its time.

    One union and one window over the key: a merge, not a range join. ``order`` breaks ties among right rows.
    """
    none = [F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values]
    at = F.lit(0 if strict else 2)
    both = right.select(key, "t", F.lit(1).alias("side"), "order", *values).unionByName(left.select(key, "t", at.alias("side"), F.lit(0).cast("long").alias("order"), *none))
    w = by(key).orderBy("t", "side", "order")
    filled = both.select(key, "t", "side", *(F.last(v, ignorenulls=True).over(w).alias(v) for v in values))
    return filled.where("side <> 1").drop("side")
