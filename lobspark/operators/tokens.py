"""Event tokens: fitted edges, encoding and its inverse, fidelity and distribution distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lobspark.functions import scalars as fn
from lobspark.operators.selection import order_statistics
from lobspark.operators.series import by


def size_edges(df: DataFrame, x: str, k: int = 8, key: str = "symbol") -> DataFrame:
    """(key, edges): the quantiles 1/k to (k-1)/k at the nearest rank, floor(q (n - 1) + 0.5), then bumped to rise.

    Ranks come from running counts over the distinct values, so that a key may have any number of rows.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(key, F.col(x).alias("x")).agg(F.count("*").alias("c"))
    run = F.sum("c").over(by(key).orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"run": run, "n": F.sum("c").over(by(key))})
    at = lambda s: F.floor(s["q"] * (F.col("n") - 1) + 0.5)
    wanted = F.filter(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(i / k).alias("q")) for i in range(1, k))), lambda s: (F.col("run") - F.col("c") <= at(s)) & (at(s) < F.col("run")))
    hit = ranked.select(key, "x", F.explode(wanted).alias("w"))
    edges = F.transform(F.array_sort(F.collect_list(F.struct("w.i", "x"))), lambda s: s["x"])
    return hit.groupBy(key).agg(edges.alias("raw")).select(key, fn.bumped_edges(F.col("raw")).alias("edges"))


def gap_edges(df: DataFrame, x: str, n_edges: int = 14, key: str = "symbol") -> DataFrame:
    """(key, edges): spaced evenly in the logarithm between the 0.1 % and 99.9 % order statistics of the positive gaps."""
    pos = df.where(F.col(x) > 0)
    at = lambda q: F.floor(q * (F.col("n") - 1) + 0.5)
    ends = order_statistics(pos, key, x, {"lo": at(0.001), "hi": at(0.999)})
    exact = F.transform(F.sequence(F.lit(0), F.lit(n_edges - 1)), lambda i: F.floor(F.exp(F.log("lo") + (F.log("hi") - F.log("lo")) * i / (n_edges - 1)) + 0.5))
    return ends.select(key, fn.bumped_edges(exact).alias("edges"))


def encode(events: DataFrame) -> DataFrame:
    """Five tokens for each event (etype, side, has_px, lvl_off, size, dt; size_edges, dt_edges)."""
    c = F.col
    tokens = F.array(fn.type_token(c("etype")), fn.side_token(c("side")), fn.px_token(c("has_px"), c("lvl_off")), fn.size_token(c("size"), c("size_edges")), fn.dt_token(c("dt"), c("dt_edges")))
    return events.withColumn("tokens", tokens)


def framed(events: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """(symbol, day, place, token): each symbol-day's stream as rows, from encoded events (symbol, day, us, seq, tokens).

    days: all (symbol, day) that have a stream, if there may be some without events.

    It begins with the specials BOS and SESSION_OPEN and ends with SESSION_CLOSE and EOS: 4 + 5 n tokens for n events.
    """
    keys = ("symbol", "day")
    rn = F.row_number().over(by(*keys).orderBy("us", "seq"))
    body = events.select(*keys, rn.alias("rn"), "tokens").select(*keys, "rn", F.posexplode("tokens").alias("j", "token"))
    body = body.select(*keys, (2 + 5 * (F.col("rn") - 1) + F.col("j")).cast("long").alias("place"), F.col("token").cast("long").alias("token"))
    end = 2 + 5 * F.col("n")
    special = F.array(*(F.struct(p.cast("long").alias("place"), F.lit(t).cast("long").alias("token")) for p, t in ((F.lit(0), fn.BOS), (F.lit(1), fn.SESSION_OPEN), (end, fn.SESSION_CLOSE), (end + 1, fn.EOS))))
    counts = events.groupBy(*keys).agg(F.count("*").alias("n"))
    if days is not None:
        counts = days.join(counts, list(keys), "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"))
    ends = counts.select(*keys, F.explode(special).alias("s")).select(*keys, "s.*")
    return body.unionByName(ends)


def decode(encoded: DataFrame) -> DataFrame:
    """What the tokens say: type, side, offset (NULL for unknown, 11 for the tail), size and gap representatives."""
    t = lambda k: F.element_at("tokens", k)
    etype = F.element_at(F.array(*map(F.lit, fn.ETYPES)), (t(1) - fn.TYPE0 + 1).cast("int"))
    side = F.when(t(2) == fn.SIDE0, "B").otherwise("S")
    px = F.when(t(3) != fn.UNK, t(3) - fn.PX0 - 1)
    size = fn.representative(t(4) - fn.SIZE0, F.col("size_edges"))
    dt = F.when(t(5) == fn.DT_ZERO, F.lit(0).cast("long")).otherwise(fn.representative(t(5) - fn.DT0, F.col("dt_edges")))
    return encoded.withColumns({"etype_": etype, "side_": side, "off_": px, "size_": size, "dt_": dt})


def fidelity(df: DataFrame, x: str, b: str, rep: str, key: str = "symbol") -> DataFrame:
    """(key, r2_rep, r2_mean, live): share of the variance that buckets keep, decoded by their representative or by
    their mean, and how many buckets occur."""
    m = df.select(key, F.col(x).cast("double").alias("x"), F.col(b).alias("b"), F.col(rep).cast("double").alias("rep"))
    m = m.select("*", F.avg("x").over(by(key)).alias("all"), F.avg("x").over(by(key, "b")).alias("mean"))
    sq = lambda c: F.sum(F.pow(F.col("x") - F.col(c), 2))
    agg = m.groupBy(key).agg(sq("rep").alias("e1"), sq("mean").alias("e2"), sq("all").alias("s"), F.countDistinct("b").alias("live"))
    r2 = lambda e: F.when(F.col("s") > 0, 1 - F.col(e) / F.col("s"))
    return agg.select(key, r2("e1").alias("r2_rep"), r2("e2").alias("r2_mean"), "live")


def total_variation(counts: DataFrame, key: str, value: str, n: str) -> DataFrame:
    """(key, tv): half the absolute difference of each group's shares from those of all other groups together."""
    total = counts.groupBy(value).agg(F.sum(n).alias("all"))
    groups = counts.groupBy(key).agg(F.sum(n).alias("own"))
    every = groups.select(key, F.sum("own").over(Window.partitionBy()).alias("grand"))  # a row a group
    # absent values: the rest's share that the group lacks
    here = counts.join(total, value).join(groups, key).join(every, key)
    rest = F.col("grand") - F.col("own")
    other = (F.col("all") - F.col(n)) / rest
    part = here.groupBy(key).agg(F.sum(F.abs(F.col(n) / F.col("own") - other)).alias("diff"), F.sum(other).alias("seen"))
    return part.select(key, (0.5 * (F.col("diff") + 1 - F.col("seen"))).alias("tv"))
