"""Statistics of return and sign series. An unmeasured statistic is NULL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lobspark.functions.scalars import TICK, spread_ticks
from lobspark.operators import series
from lobspark.operators.selection import top_sums
from lobspark.operators.series import by
from lobspark.sources.tables import checkpointed


def excess_kurtosis(df: DataFrame, x: str = "r") -> DataFrame:
    """(symbol, n, kurt): m4 / m2**2 - 3 of the population; four values at least, and not all the same."""
    return df.groupBy("symbol").agg(F.count(x).alias("n"), F.kurtosis(x).alias("k")).select("symbol", "n", F.when(F.col("n") >= 4, F.col("k")).alias("kurt"))


def zero_fraction(df: DataFrame, x: str = "r") -> DataFrame:
    return df.groupBy("symbol").agg(F.avg((F.col(x) == 0).cast("double")).alias("zero_fraction"))


#: Values of a series that are worked on at once.
BLOCK = 50_000


def lagged_products(lags: int, block: int):
    """Of a block's values in order (and those that follow, up to ``lags``) the sum of products for each lag."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        at = group["block"].iloc[0]
        d = group.sort_values("i")
        i, v = d["i"].to_numpy(), d["d"].to_numpy()
        n = int((i < (at + 1) * block).sum())
        sums = [float(v[: min(n, len(v) - k)] @ v[k : k + n]) if k < len(v) else 0.0 for k in range(1, lags + 1)]
        return pd.DataFrame({"symbol": [group["symbol"].iloc[0]], "s": [sums]})

    return run


def acf(df: DataFrame, lags: int, x: str = "r", cap: Column | None = None, block: int = BLOCK) -> DataFrame:
    """(symbol, lag, acf) for lags from 1: sum of (x_i - m)(x_{i-k} - m) over the full sum of squares.

    m is the symbol's mean over all values. Three values at least, and not all the same; lags below the number of values.
    cap: the largest lag of a symbol, from its count ``n``. i numbers a symbol's values without holes.

    A long series is dealt out in blocks that share what lags need at their border, so that a group has ``block``
    values and ``lags`` more, whatever the symbol; sums of products of a block add up. What is broadcast has a row a symbol.
    """
    block = max(block, lags)
    df = checkpointed(df.select("symbol", "i", x))
    means = df.groupBy("symbol").agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    means = means.where("n >= 3 AND v > 0").withColumn("s2", F.col("v") * F.col("n"))
    own = F.floor(F.col("i") / block)
    each = F.when((F.col("i") % block < lags), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = df.join(F.broadcast(means), "symbol").select("symbol", "i", (F.col(x) - F.col("m")).alias("d"), F.explode(each).alias("block"))
    kind = df.schema["symbol"].dataType.simpleString()
    sums = dealt.groupBy("symbol", "block").applyInPandas(lagged_products(lags, block), f"symbol {kind}, s array<double>")
    sums = sums.select("symbol", F.posexplode("s").alias("k", "s")).groupBy("symbol", "k").agg(F.sum("s").alias("s"))
    out = sums.join(means, "symbol").where(F.col("k") + 1 < F.col("n"))
    if cap is not None:
        out = out.where(F.col("k") + 1 <= cap)
    return out.select("symbol", (F.col("k") + 1).cast("long").alias("lag"), (F.col("s") / F.col("s2")).alias("acf"))


def at_lags(curve: DataFrame, names: dict[int, str]) -> DataFrame:
    """(symbol, and a column for each lag in names): a curve's values at some lags, NULL where it has none."""
    of = lambda k: F.max(F.when(F.col("lag") == k, F.col("acf")))
    return curve.groupBy("symbol").agg(*(of(k).alias(name) for k, name in names.items()))


def loglog_slope(curve: DataFrame, most: int = 100, least_points: int = 5) -> DataFrame:
    """(symbol, points, slope): least squares of ln(acf) on ln(lag) over the lags with a positive acf."""
    fit = curve.where((F.col("acf") > 1e-12) & (F.col("lag") <= most))  # below it is a zero's rounding noise
    fit = fit.groupBy("symbol").agg(F.count("*").alias("points"), F.regr_slope(F.log("acf"), F.log("lag")).alias("s"))
    return fit.select("symbol", "points", F.when(F.col("points") >= least_points, F.col("s")).alias("slope"))


def hill_alpha(df: DataFrame, x: str = "r", share: float = 0.05, least: int = 20, least_k: int = 10) -> DataFrame:
    """(symbol, n, k, alpha): over the non-zero absolute values, k over the sum of ln(x_i / x_{k+1}), largest first."""
    size = df.select("symbol", F.abs(x).alias("a")).where("a > 0")
    k = lambda n: F.greatest(F.lit(least_k), F.floor(share * n)).cast("long")
    sums = top_sums(size, "symbol", "a", k(F.col("n")) + 1, lambda a, edge: F.log(a) - F.log(edge))
    alpha = F.when(F.col("above") > 0, k(F.col("n")) / F.col("above"))
    return sums.select("symbol", "n", k(F.col("n")).alias("k"), F.when(F.col("n") >= least, alpha).alias("alpha"))


def top_variance(df: DataFrame, x: str = "r", top: int = 10, least: int = 20) -> DataFrame:
    """(symbol, n, cv, vartop): of the absolute values, the coefficient of variation and the share of the centred sum of
    squares that the ``top`` largest deviations have."""
    size = df.select("symbol", F.abs(x).alias("a"))
    dev = size.join(size.groupBy("symbol").agg(F.avg("a").alias("m")), "symbol")
    dev = checkpointed(dev.select("symbol", "m", F.pow(F.col("a") - F.col("m"), 2).alias("d2")))
    sums = dev.groupBy("symbol").agg(F.count("*").alias("n"), F.first("m").alias("m"), F.sum("d2").alias("s2"))
    agg = sums.join(top_sums(dev, "symbol", "d2", F.lit(top), lambda d, edge: d).select("symbol", F.col("above").alias("t2")), "symbol", "left")
    ok = (F.col("n") >= least) & (F.col("s2") > 0)
    return agg.select("symbol", "n", F.when(ok, F.sqrt(F.col("s2") / F.col("n")) / F.col("m")).alias("cv"), F.when(ok, F.col("t2") / F.col("s2")).alias("vartop"))


#: The summary's columns in the order of its file (fixed values); "1s", "10s" and "60s" are its three grids.
SUMMARY = """symbol n_event zero_frac_event kurt_event kurt_tick n_1s zero_frac_1s kurt_1s kurt_1s_nonzero kurt_10s kurt_60s
hill_event hill_1s acf1_r_event acf1_r_1s acf1_absr_1s acf10_absr_1s acf50_absr_1s acf100_absr_1s n_tick acf1_absr_tick
acf10_absr_tick acf50_absr_tick acf100_absr_tick n_signs acf1_sign acf10_sign acf100_sign acf1000_sign sign_loglog_slope
n_msgs_w twosided_frac med_spread_ticks med_mid rel_tick_bp n_exec cv_absr_tick vartop10_absr_tick""".split()


def most_sign_lag(most: int = 1000):
    """The largest lag of a sign series: a quarter of its length, ``most`` at the most."""
    return F.least(F.lit(most), F.floor(F.col("n") / 4))


def _named(kind: str):
    """A series of a symbol as a key of its own."""
    return F.concat_ws("|", "symbol", F.lit(kind)).alias("symbol")


def _measures(rows: DataFrame, **names: tuple[str, str]) -> DataFrame:
    """(symbol, name, value) of some columns of rows by series; a name is the series between two given parts."""
    series_of = F.substring_index("symbol", "|", -1)
    each = F.array(*(F.struct(F.concat(F.lit(a), series_of, F.lit(b)).alias("name"), F.col(c).cast("double").alias("value")) for c, (a, b) in names.items()))
    return rows.select(F.substring_index("symbol", "|", 1).alias("symbol"), F.explode(each).alias("m")).select("symbol", "m.*")


def summary(touch: DataFrame, fills: DataFrame, step: int, window: int, tick: int = TICK) -> DataFrame:
    """A row of ``SUMMARY`` for each symbol.

    touch: (symbol, ts, seq, bid, ask) after each message, NULL for an empty side; fills: (symbol, ts, seq, sign,
    shares). The grids are multiples of ``step``, 10 and 60 steps; ``window`` joins fills to decisions. All series are put
    under each other, with the series in the key, so that each statistic is one plan for all of them.
    """
    both = touch.where("bid IS NOT NULL AND ask IS NOT NULL")
    mids = checkpointed(series.ordered(both.select("symbol", "ts", "seq", ((F.col("bid") + F.col("ask")) / 20000.0).alias("mid"), spread_ticks(F.col("bid"), F.col("ask"), tick).alias("spread")), "ts", "seq"))
    event = mids.drop("spread")
    shapes = {"event": event, "tick": series.tick_series(event)} | {f"{k}s": series.locf_grid(event, k * step) for k in (1, 10, 60)}
    r = None
    for kind, shape in shapes.items():
        part = series.log_returns(shape).select(_named(kind), "i", "r")
        r = part if r is None else r.unionByName(part)
    r = checkpointed(r)
    of = lambda *kinds: r.where(F.substring_index("symbol", "|", -1).isin(*kinds))
    size = lambda rows: rows.withColumn("r", F.abs("r"))
    nonzero = F.when(F.col("r") != 0, F.col("r"))
    enough = lambda x: F.when(F.count(x) >= 4, F.kurtosis(x))
    moments = r.groupBy("symbol").agg(F.count("r").alias("n"), F.avg((F.col("r") == 0).cast("double")).alias("zero"), enough(F.col("r")).alias("kurt"), enough(nonzero).alias("kurt0"))
    made = checkpointed(series.decisions(fills, window))
    signs = acf(made.select(_named("sign"), F.col("decision").alias("i"), F.col("sign").cast("double").alias("r")), 1000, cap=most_sign_lag())
    middle = mids.select(_named("mid"), F.col("mid").alias("x")).unionByName(mids.select(_named("spread_ticks"), F.col("spread").cast("double").alias("x")))
    two_sided = (F.col("bid").isNotNull() & F.col("ask").isNotNull()).cast("double")
    parts = [
        _measures(moments, n=("n_", ""), zero=("zero_frac_", ""), kurt=("kurt_", ""), kurt0=("kurt_", "_nonzero")),
        _measures(hill_alpha(of("event", "1s")), alpha=("hill_", "")),
        _measures(top_variance(of("tick")), cv=("cv_absr_", ""), vartop=("vartop10_absr_", "")),
        _measures(at_lags(acf(of("event", "1s"), 1), {1: "a"}), a=("acf1_r_", "")),
        _measures(at_lags(acf(size(of("1s", "tick")), 100), {k: f"a{k}" for k in (1, 10, 50, 100)}), **{f"a{k}": (f"acf{k}_absr_", "") for k in (1, 10, 50, 100)}),
        _measures(at_lags(signs, {k: f"a{k}" for k in (1, 10, 100, 1000)}), **{f"a{k}": (f"acf{k}_", "") for k in (1, 10, 100, 1000)}),
        _measures(loglog_slope(signs), slope=("", "_loglog_slope")),
        _measures(made.groupBy(_named("sign")).agg(F.count("*").alias("n")), n=("n_", "s")),
        _measures(series.upper_median(middle, "symbol", "x", "m"), m=("med_", "")),
        _measures(fills.groupBy(_named("exec")).agg(F.count("*").alias("n")), n=("n_", "")),
        _measures(touch.groupBy(_named("")).agg(F.count("*").alias("n"), F.avg(two_sided).alias("two")), n=("n_msgs_w", ""), two=("twosided_frac", "")),
    ]
    long = parts[0]
    for part in parts[1:]:
        long = long.unionByName(part)
    wide = long.groupBy("symbol").agg(*(F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in SUMMARY if c not in ("symbol", "rel_tick_bp")))
    counts = {c: F.coalesce(F.col(c), F.lit(0.0)).cast("long") for c in SUMMARY if c.startswith("n_")}
    kind = touch.schema["symbol"].dataType
    return wide.withColumns({**counts, "symbol": F.col("symbol").cast(kind), "rel_tick_bp": tick / 1e4 / F.col("med_mid") * 10000}).select(*SUMMARY)


def rank_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson's correlation of the ranks (ties share the least) over a small frame of one row a symbol."""
    w = Window.orderBy
    ranked = df.select(F.rank().over(w(a)).cast("double").alias("ra"), F.rank().over(w(b)).cast("double").alias("rb"))
    return ranked.agg(F.corr("ra", "rb").alias("rank_corr"))
