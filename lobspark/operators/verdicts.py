"""Verdict tables over per-symbol and per-day statistics, and sampling from counts and logits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lobspark.operators.series import by, decisions


def presence(stats: DataFrame, most_vartop: float = 0.5) -> DataFrame:
    """stats: symbol, n, vartop, acf10. UNMEASURED where a few values make the variance, else by two standard errors."""
    verdict = F.when(F.col("vartop").isNull() | (F.col("vartop") >= most_vartop), "UNMEASURED").when(F.col("acf10") > 2 / F.sqrt("n"), "PRESENT").otherwise("ABSENT")
    return stats.withColumn("verdict", verdict)


def cross_day(daily: DataFrame, x: str) -> DataFrame:
    """The median over days of the median over symbols, with the days' range."""
    d = daily.groupBy("day").agg(F.median(x).alias("med"))
    return d.agg(F.round(F.median("med"), 6).alias("med"), F.round(F.min("med"), 6).alias("lo"), F.round(F.max("med"), 6).alias("hi"), F.count("*").alias("days"))


def measurable(daily: DataFrame, most: int) -> DataFrame:
    """(k, symbols): how many symbols are measurable on k days or more."""
    q = daily.groupBy("symbol").agg(F.count_if("ok").alias("days"))
    each = q.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: F.struct(k.cast("long").alias("k"), (F.col("days") >= k).alias("y")))).alias("s"))
    return each.groupBy("s.k").agg(F.count_if("s.y").alias("symbols"))


def envelope(daily: DataFrame, x: str) -> DataFrame:
    """(symbol, q10, q90, k): quantiles by linear interpolation at p (k - 1)."""
    return daily.groupBy("symbol").agg(F.round(F.percentile(x, 0.1), 6).alias("q10"), F.round(F.percentile(x, 0.9), 6).alias("q90"), F.count(x).alias("k"))


def beat(daily: DataFrame, least_days: int = 5, least_n: int = 10) -> DataFrame:
    """(symbol, verdict): whether the last day's value lies in the envelope of the earlier days."""
    c = daily.withColumn("rn", F.row_number().over(by("symbol").orderBy(F.desc("day"))))
    e = c.where("rn > 1").groupBy("symbol").agg(F.percentile("m", 0.1).alias("q10"), F.percentile("m", 0.9).alias("q90"), F.count("m").alias("k"))
    verdict = F.when((F.col("k") < least_days) | (F.col("n") < least_n), "INCONCLUSIVE").when(F.col("m").between(F.col("q10"), F.col("q90")), "PASS").otherwise("FAIL")
    return c.where("rn = 1").join(e, "symbol").select("symbol", verdict.alias("verdict"))


def inverse_cdf(counts: DataFrame, key: str, value: str, n: str, draws: int) -> DataFrame:
    """(key, j, drawn) at the uniforms (j + 0.5) / draws. Every value takes the draws between its own running share and
    the one before: an explode of its range, no search."""
    w = by(key).orderBy(value)
    c = counts.withColumns({"cum": F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum(n).over(by(key))})
    last = lambda cum: F.floor(cum / F.col("total") * draws - 0.5)
    c = c.withColumn("a", last(F.col("cum") - F.col(n)) + 1).withColumn("b", F.least(last(F.col("cum")), F.lit(draws - 1)))
    return c.where("a <= b").select(key, F.explode(F.sequence("a", "b")).alias("j"), F.col(value).alias("drawn"))


def uniform(seed: int, *keys: str) -> Column:
    """A number from 0 to below 1 that hangs on the seed and the keys alone, however rows are grouped or split."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *(F.col(k).cast("string") for k in keys))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def sampled(counts: DataFrame, draws: DataFrame, value: str, n: str, key: str = "symbol", empty: int = 100) -> DataFrame:
    """(key, j, drawn) for draws (key, j, u): the first value whose running count reaches u times the total.

    One merge of counts and draws by descending running count. ``empty``: what a key without counts gives.
    """
    run = counts.select(key, value, F.sum(n).over(by(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("t"))
    total = counts.groupBy(key).agg(F.sum(n).alias("total"))
    asked = draws.join(total, key, "left").select(key, "j", (F.col("u") * F.col("total")).alias("t"))
    both = run.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    found = both.withColumn("drawn", F.last(value, ignorenulls=True).over(by(key).orderBy(F.desc("t"), "kind")))
    return found.where("kind = 1").select(key, "j", F.coalesce("drawn", F.lit(empty)).alias("drawn"))


def masked_softmax(logits: DataFrame, top: int, temperature: float, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, token, p) over the ``top`` largest logits of each key and those that tie with the last of them."""
    t = temperature if temperature > 0 else 1.0
    ranked = logits.withColumn("rank", F.rank().over(by(*keys).orderBy(F.desc("logit")))).where(F.col("rank") <= top)
    e = ranked.select(*keys, "token", F.exp((F.col("logit") - F.max("logit").over(by(*keys))) / t).alias("e"))
    return e.select(*keys, "token", (F.col("e") / F.sum("e").over(by(*keys))).alias("p"))


def viability(replayed: DataFrame, window: int, least_signs: int = 500, least_two_sided: float = 0.9) -> DataFrame:
    """(locate, signs, v1, v2, v3, viable): enough sign decisions, two-sided often enough, never without orders."""
    fills = replayed.where("msg_type = 'E' AND result = 'Ok'").select(F.col("locate").alias("symbol"), F.col("us").alias("ts"), "seq", F.when(F.col("side") == "S", 1).otherwise(-1).alias("sign"), "shares")
    signs = decisions(fills, window).groupBy("symbol").agg(F.count("*").alias("signs")).withColumnRenamed("symbol", "locate")
    both = (F.col("bid").isNotNull() & F.col("ask").isNotNull()).cast("double")
    state = replayed.groupBy("locate").agg(F.avg(both).alias("two"), F.min(F.when(F.col("open_orders") == 0, F.col("seq"))).alias("dead"))
    v1, v2, v3 = F.col("signs") >= least_signs, F.col("two") >= least_two_sided, F.col("dead").isNull()
    return signs.join(state, "locate").select("locate", "signs", v1.alias("v1"), v2.alias("v2"), v3.alias("v3"), (v1 & v2 & v3).alias("viable"))
