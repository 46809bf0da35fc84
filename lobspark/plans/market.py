"""Queries over price series and fills."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lobspark.functions import scalars as fn
from lobspark.operators import series, stats
from lobspark.operators.selection import order_statistics
from lobspark.plans.common import COARSE, EV, FILLS, HOUR, RETURNS, SERIES, acf_sql, coarse_series, coarsened, decisions_sql, events, fills, price_series, rounded
from lobspark.sources.tables import checkpointed

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def returns(spark, sf_dir):
    return series.log_returns(price_series(spark, sf_dir))


@query("y07_acf_returns", f"WITH {RETURNS}, {acf_sql('r', 'range(1, 51)')} SELECT symbol, lag, round(acf, 6) AS acf FROM acf")
def y07(spark, sf_dir):
    """Lags 1 to 50."""
    return rounded(stats.acf(returns(spark, sf_dir), 50), "acf")


@query("y05_kurtosis", f"WITH {RETURNS} SELECT symbol, count(*) AS n, round(CASE WHEN count(*) >= 4 THEN kurtosis_pop(r) END, 6) AS kurt FROM r GROUP BY symbol")
def y05(spark, sf_dir):
    return rounded(stats.excess_kurtosis(returns(spark, sf_dir)), "kurt")


@query("y06_zero_returns", f"WITH {COARSE}, r AS (SELECT symbol, ln(mid / lag(mid) OVER (PARTITION BY symbol ORDER BY i)) AS r FROM c) SELECT symbol, round(avg(CASE WHEN r = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_fraction FROM r WHERE r IS NOT NULL GROUP BY symbol")
def y06(spark, sf_dir):
    return rounded(stats.zero_fraction(series.log_returns(coarse_series(spark, sf_dir))), "zero_fraction")


@query("y03_tick_series", f"WITH {COARSE}, t AS (SELECT *, lag(mid) OVER (PARTITION BY symbol ORDER BY i) AS last FROM c) SELECT symbol, ts, seq, mid, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS i FROM t WHERE last IS NULL OR mid <> last")
def y03(spark, sf_dir):
    return series.tick_series(coarse_series(spark, sf_dir)).select("symbol", "ts", "seq", "mid", "i")


GRID = f"""g0 AS (SELECT symbol, CAST(ceil(min(ts) / {HOUR}.0) AS BIGINT) AS a, CAST(floor(max(ts) / {HOUR}.0) AS BIGINT) AS b FROM s GROUP BY symbol),
g1 AS (SELECT symbol, unnest(generate_series(a, b)) * {HOUR} AS ts FROM g0 WHERE a <= b),
g AS (SELECT g1.symbol, g1.ts, s.mid, row_number() OVER (PARTITION BY g1.symbol ORDER BY g1.ts) AS i FROM g1 ASOF JOIN s ON g1.symbol = s.symbol AND g1.ts >= s.ts)"""


@query("y04_locf_grid", f"WITH {SERIES}, {GRID} SELECT symbol, ts, mid, i FROM g")
def y04(spark, sf_dir):
    return series.locf_grid(price_series(spark, sf_dir), HOUR).select("symbol", "ts", "mid", "i")


HILL = """h0 AS (SELECT symbol, abs(r) AS a, row_number() OVER (PARTITION BY symbol ORDER BY abs(r) DESC) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM r WHERE r <> 0),
h1 AS (SELECT *, greatest(10, CAST(floor(0.05 * n) AS BIGINT)) AS k FROM h0),
h2 AS (SELECT symbol, max(n) AS n, max(k) AS k, max(CASE WHEN rn = k + 1 THEN a END) AS edge FROM h1 GROUP BY symbol),
hill AS (SELECT symbol, max(h2.n) AS n, max(h2.k) AS k, CASE WHEN max(h2.n) >= 20 THEN max(h2.k) / sum(ln(a / edge)) END AS alpha FROM h1 JOIN h2 USING (symbol) WHERE rn <= h2.k GROUP BY symbol)"""


@query("y08_hill_tail", f"WITH {RETURNS}, {HILL} SELECT symbol, n, CAST(k AS BIGINT) AS k, round(alpha, 6) AS alpha FROM hill")
def y08(spark, sf_dir):
    return rounded(stats.hill_alpha(returns(spark, sf_dir)), "alpha")


@query("y09_sign_decisions", f"WITH {FILLS}, {decisions_sql(HOUR)} SELECT * FROM dec")
def y09(spark, sf_dir):
    return series.decisions(fills(spark, sf_dir), HOUR)


SIGNS = f"{FILLS}, {decisions_sql(HOUR)}, sg AS (SELECT symbol, decision AS i, CAST(sign AS DOUBLE) AS r FROM dec)"
CAPPED = "capped AS (SELECT * FROM acf WHERE lag <= least(1000, n // 4))"
SLOPE = "slope AS (SELECT symbol, count(*) AS points, CASE WHEN count(*) >= 5 THEN regr_slope(ln(acf), ln(lag)) END AS slope FROM capped WHERE acf > 1e-12 AND lag <= 100 GROUP BY symbol)"


def sign_acf(spark, sf_dir):
    signs = series.decisions(fills(spark, sf_dir), HOUR).select("symbol", F.col("decision").alias("i"), F.col("sign").cast("double").alias("r"))
    return stats.acf(signs, 1000, cap=stats.most_sign_lag())


@query("y11_sign_acf", f"WITH {SIGNS}, {acf_sql('sg', 'range(1, 1001)')}, {CAPPED} SELECT symbol, lag, round(acf, 6) AS acf FROM capped")
def y11(spark, sf_dir):
    return rounded(sign_acf(spark, sf_dir), "acf")


@query("y10_decay_slope", f"WITH {SIGNS}, {acf_sql('sg', 'range(1, 1001)')}, {CAPPED}, {SLOPE} SELECT symbol, points, round(slope, 6) AS slope FROM slope")
def y10(spark, sf_dir):
    return rounded(stats.loglog_slope(sign_acf(spark, sf_dir)), "slope")


@query("y12_upper_median", f"WITH {SERIES}, k AS (SELECT symbol, mid, row_number() OVER (PARTITION BY symbol ORDER BY mid) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM s) SELECT symbol, mid AS med_mid FROM k WHERE rn - 1 = n // 2")
def y12(spark, sf_dir):
    return series.upper_median(price_series(spark, sf_dir), "symbol", "mid", "med_mid")


VARTOP = """d0 AS (SELECT symbol, abs(r) AS a, avg(abs(r)) OVER (PARTITION BY symbol) AS m FROM r),
d1 AS (SELECT symbol, m, (a - m) * (a - m) AS d2, row_number() OVER (PARTITION BY symbol ORDER BY (a - m) * (a - m) DESC) AS rn FROM d0),
vt AS (SELECT symbol, count(*) AS n, CASE WHEN count(*) >= 20 AND sum(d2) > 0 THEN sqrt(sum(d2) / count(*)) / max(m) END AS cv, CASE WHEN count(*) >= 20 AND sum(d2) > 0 THEN sum(CASE WHEN rn <= 10 THEN d2 ELSE 0 END) / sum(d2) END AS vartop FROM d1 GROUP BY symbol)"""


@query("y14_top_variance", f"WITH {RETURNS}, {VARTOP} SELECT symbol, n, round(cv, 6) AS cv, round(vartop, 6) AS vartop FROM vt")
def y14(spark, sf_dir):
    return rounded(stats.top_variance(returns(spark, sf_dir)), "cv", "vartop")


@query("y15_relative_tick", f"WITH {SERIES}, k AS (SELECT symbol, mid, row_number() OVER (PARTITION BY symbol ORDER BY mid) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM s) SELECT symbol, round(0.01 / mid * 10000, 6) AS tick_bp FROM k WHERE rn - 1 = n // 2")
def y15(spark, sf_dir):
    med = series.upper_median(price_series(spark, sf_dir), "symbol", "mid", "m")
    return rounded(med.select("symbol", (0.01 / F.col("m") * 10000).alias("tick_bp")), "tick_bp")


def scales(spark, sf_dir):
    prices = checkpointed(price_series(spark, sf_dir))
    coarse = coarsened(prices)
    return {"event": coarse, "grid": series.locf_grid(prices, HOUR), "tick": series.tick_series(coarse)}


def _abs_acf_sql(source: str, name: str) -> str:
    return f"""SELECT * FROM (WITH rr AS (SELECT symbol, i - 1 AS i, abs(ln(mid / lag(mid) OVER (PARTITION BY symbol ORDER BY i))) AS r FROM {source}), q AS (SELECT * FROM rr WHERE r IS NOT NULL), {acf_sql("q", "range(1, 101)")}
SELECT '{name}' AS scale, symbol, lag, round(acf, 6) AS acf FROM acf)"""


TICKS = "tk0 AS (SELECT *, lag(mid) OVER (PARTITION BY symbol ORDER BY i) AS last FROM c), tk AS (SELECT symbol, ts, seq, mid, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS i FROM tk0 WHERE last IS NULL OR mid <> last)"


@query("y17_abs_acf_scales", f"WITH {COARSE}, {GRID}, {TICKS} {_abs_acf_sql('c', 'event')} UNION ALL {_abs_acf_sql('g', 'grid')} UNION ALL {_abs_acf_sql('tk', 'tick')}")
def y17(spark, sf_dir):
    out = None
    for name, s in scales(spark, sf_dir).items():
        r = series.log_returns(s).withColumn("r", F.abs("r"))
        part = rounded(stats.acf(r, 100), "acf").select(F.lit(name).alias("scale"), "symbol", "lag", "acf")
        out = part if out is None else out.unionByName(part)
    return out


@query("y18_grid_kurtosis", f"WITH {SERIES}, {GRID}, q AS (SELECT symbol, ln(mid / lag(mid) OVER (PARTITION BY symbol ORDER BY i)) AS r FROM g) SELECT symbol, count(*) AS n, round(CASE WHEN count(*) >= 4 THEN kurtosis_pop(r) END, 6) AS kurt FROM q WHERE r <> 0 GROUP BY symbol")
def y18(spark, sf_dir):
    r = series.log_returns(series.locf_grid(price_series(spark, sf_dir), HOUR)).where("r <> 0")
    return rounded(stats.excess_kurtosis(r), "kurt")


@query("y01_top_symbols", f"WITH {EV} SELECT user_id AS symbol, count(*) AS n FROM ev GROUP BY user_id ORDER BY n DESC, symbol LIMIT 20")
def y01(spark, sf_dir):
    """The report of the 20 busiest; ties go to the lower number."""
    return events(spark, sf_dir).groupBy(F.col("user_id").alias("symbol")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "symbol").limit(20)


GAPS = f"{FILLS}, gp AS (SELECT symbol, sign, ts, lag(sign) OVER w AS last_sign, ts - lag(ts) OVER w AS gap FROM f WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq))"


def gaps(spark, sf_dir):
    w = series.by("symbol").orderBy("ts", "seq")
    return fills(spark, sf_dir).select("symbol", "sign", F.lag("sign").over(w).alias("last_sign"), (F.col("ts") - F.lag("ts").over(w)).alias("gap"))


@query("g01_gap_histogram", f"""WITH {GAPS} SELECT CASE WHEN sign <> last_sign THEN 'flip' WHEN gap = 0 THEN 'zero' ELSE 'gap' END AS kind,
CASE WHEN sign = last_sign AND gap > 0 THEN CAST(greatest(0, least(25, floor(log10(gap * 1000.0) * 2))) AS BIGINT) END AS bucket, count(*) AS n FROM gp WHERE last_sign IS NOT NULL GROUP BY ALL""")
def g01(spark, sf_dir):
    g = gaps(spark, sf_dir).where("last_sign IS NOT NULL")
    kind = F.when(F.col("sign") != F.col("last_sign"), "flip").when(F.col("gap") == 0, "zero").otherwise("gap")
    bucket = F.when(F.col("sign") == F.col("last_sign"), fn.half_decade(F.col("gap") * 1000))
    return g.groupBy(kind.alias("kind"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


PS = (0.1, 0.5, 0.9, 0.99)


@query("g02_gap_quantiles", f"""WITH {GAPS}, k AS (SELECT symbol, gap, row_number() OVER (PARTITION BY symbol ORDER BY gap) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM gp WHERE sign = last_sign)
SELECT symbol, p, gap FROM k JOIN (SELECT unnest([0.1, 0.5, 0.9, 0.99]::DOUBLE[]) AS p) q ON rn - 1 = CAST(floor(p * (n - 1)) AS BIGINT)""")
def g02(spark, sf_dir):
    g = gaps(spark, sf_dir).where("sign = last_sign")
    at = order_statistics(g, "symbol", "gap", {f"p{i}": F.floor(p * (F.col("n") - 1)) for i, p in enumerate(PS)})
    each = F.array(*(F.struct(F.lit(p).alias("p"), F.col(f"p{i}").alias("gap")) for i, p in enumerate(PS)))
    return at.select("symbol", F.explode(each).alias("q")).select("symbol", "q.*").where("gap IS NOT NULL")


@query("f01_value_histogram", f"WITH {FILLS} SELECT shares, count(*) AS n FROM f GROUP BY shares ORDER BY n DESC, shares LIMIT 20")
def f01(spark, sf_dir):
    return fills(spark, sf_dir).groupBy("shares").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "shares").limit(20)


@query("f02_weighted_percentiles", f"""WITH {FILLS}, h AS (SELECT symbol, shares, count(*) AS c FROM f GROUP BY ALL),
k AS (SELECT symbol, shares, sum(c) OVER (PARTITION BY symbol ORDER BY shares) AS run, sum(c) OVER (PARTITION BY symbol) AS n FROM h)
SELECT symbol, p, min(shares) AS value FROM k, (SELECT unnest([0.5, 0.99]::DOUBLE[]) AS p) q WHERE run > floor(p * (n - 1)) GROUP BY symbol, p""")
def f02(spark, sf_dir):
    h = fills(spark, sf_dir).groupBy("symbol", "shares").agg(F.count("*").alias("c"))
    parts = [series.weighted_percentile(h, "symbol", "shares", "c", p).select("symbol", F.lit(p).alias("p"), "value") for p in (0.5, 0.99)]
    return parts[0].unionByName(parts[1])


@query("f03_share_structure", f"WITH {FILLS} SELECT symbol, count(*) AS n, count(DISTINCT shares) AS n_distinct, count(*) FILTER (shares % 300 = 0) AS multiples, count(*) FILTER (shares < 300) AS odd_lots, round(avg(shares), 6) AS mean FROM f GROUP BY symbol")
def f03(spark, sf_dir):
    return fills(spark, sf_dir).groupBy("symbol").agg(
        F.count("*").alias("n"), F.countDistinct("shares").alias("n_distinct"), F.count_if(F.col("shares") % 300 == 0).alias("multiples"), F.count_if(F.col("shares") < 300).alias("odd_lots"), F.round(F.avg("shares"), 6).alias("mean")
    )


@query("f05_price_structure", f"WITH {EV}, p AS (SELECT event_type, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents FROM ev) SELECT event_type, count(*) AS n, count(*) FILTER (cents % 100 = 0) AS whole, count(*) FILTER (cents < 100) AS below_one, count(*) FILTER (cents > 10000) AS above_hundred, min(cents) AS lo, max(cents) AS hi FROM p GROUP BY event_type")
def f05(spark, sf_dir):
    cents = F.floor(F.col("value") * 100 + 0.5)
    return events(spark, sf_dir).select("event_type", cents.alias("cents")).groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("cents") % 100 == 0).alias("whole"), F.count_if(F.col("cents") < 100).alias("below_one"), F.count_if(F.col("cents") > 10000).alias("above_hundred"), F.min("cents").alias("lo"), F.max("cents").alias("hi")
    )


@query("x04_window_sweep", " UNION ALL ".join(f"SELECT CAST({w} AS BIGINT) AS collapse, symbol, count(*) AS n, CAST(max(fills) AS BIGINT) AS most FROM (WITH {FILLS}, {decisions_sql(w)} SELECT * FROM dec) GROUP BY symbol" for w in (0, 60_000_000, HOUR, 6 * HOUR)))
def x04(spark, sf_dir):
    """All windows in one pass: a fill starts a decision if it flips the sign or its gap is above the window."""
    f = fills(spark, sf_dir)
    w = series.by("symbol").orderBy("ts", "seq")
    base = f.select("symbol", "ts", "seq", (F.lag("sign").over(w).isNull() | (F.lag("sign").over(w) != F.col("sign"))).alias("flip"), (F.col("ts") - F.lag("ts").over(w)).alias("gap"))
    each = base.select("*", F.explode(F.array(*(F.lit(x).cast("long") for x in (0, 60_000_000, HOUR, 6 * HOUR)))).alias("collapse"))
    each = each.withColumn("decision", F.sum((F.col("flip") | (F.col("gap") > F.col("collapse"))).cast("long")).over(series.by("symbol", "collapse").orderBy("ts", "seq")))
    sizes = each.groupBy("collapse", "symbol", "decision").agg(F.count("*").alias("fills"))
    return sizes.groupBy("collapse", "symbol").agg(F.count("*").alias("n"), F.max("fills").alias("most"))


@query("x05_context_gate", f"WITH {FILLS}, {decisions_sql(HOUR)}, a AS (SELECT user_id % 8 AS symbol, count(*) AS msgs FROM ev GROUP BY 1), b AS (SELECT symbol, count(*) AS signs FROM dec GROUP BY symbol) SELECT symbol, CAST(k AS BIGINT) AS lag, round(k * (msgs / signs) * 5, 6) AS tokens FROM a JOIN b USING (symbol), (SELECT unnest([1, 10, 100]) AS k) q")
def x05(spark, sf_dir):
    a = price_series(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("msgs"))
    b = series.decisions(fills(spark, sf_dir), HOUR).groupBy("symbol").agg(F.count("*").alias("signs"))
    lag = F.explode(F.array(*(F.lit(k).cast("long") for k in (1, 10, 100))))
    return a.join(b, "symbol").select("symbol", lag.alias("lag"), "msgs", "signs").select("symbol", "lag", F.round(F.col("lag") * (F.col("msgs") / F.col("signs")) * 5, 6).alias("tokens"))


@query("x12_rank_correlation", f"WITH {RETURNS}, {VARTOP}, k AS (SELECT rank() OVER (ORDER BY n) AS a, rank() OVER (ORDER BY vartop) AS b FROM vt) SELECT round(corr(a, b), 6) AS rank_corr FROM k")
def x12(spark, sf_dir):
    return rounded(stats.rank_correlation(stats.top_variance(returns(spark, sf_dir)), "n", "vartop"), "rank_corr")


@query("o02_longest_run", f"WITH {COARSE}, m AS (SELECT symbol, i, CASE WHEN mid < 100 THEN 1 ELSE 0 END AS flag FROM c), k AS (SELECT symbol, flag, i - sum(flag) OVER (PARTITION BY symbol ORDER BY i) AS island FROM m), z AS (SELECT symbol, island, sum(flag) AS n FROM k GROUP BY ALL) SELECT symbol, CAST(max(n) AS BIGINT) AS longest FROM z GROUP BY symbol")
def o02(spark, sf_dir):
    return series.longest_run(coarse_series(spark, sf_dir), "symbol", "i", F.col("mid") < 100)


@query("s06_type_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def s06(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))


@query("p12_train_prefix", f"WITH {SERIES}, k AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM s) SELECT symbol, i, mid FROM k WHERE i <= CAST(floor(0.7 * n) AS BIGINT)")
def p12(spark, sf_dir):
    n = F.count("*").over(series.by("symbol"))
    return price_series(spark, sf_dir).withColumn("n", n).where(F.col("i") <= F.floor(0.7 * F.col("n"))).select("symbol", "i", "mid")


@query("p14_session_clock", f"""WITH {EV}, t AS (SELECT event_id, (us % 86400000000) * 1000 AS ns FROM ev)
SELECT event_id, ns, ns >= 34200000000000 AND ns < 57600000000000 AS in_win, printf('%02d:%02d:%02d', ns // 3600000000000, ns // 60000000000 % 60, ns // 1000000000 % 60) AS clock FROM t""")
def p14(spark, sf_dir):
    t = events(spark, sf_dir).select("event_id", (F.col("us") % 86_400_000_000 * 1000).alias("ns"))
    return t.select("event_id", "ns", fn.in_session(F.col("ns")).alias("in_win"), fn.clock(F.col("ns")).alias("clock"))


@query("t05_session_gaps", f"""WITH {EV}, t AS (SELECT user_id % 8 AS symbol, event_id, us, (us % 86400000000) * 1000 AS ns FROM ev),
k AS (SELECT *, us - lag(us) OVER (PARTITION BY symbol, us // 86400000000 ORDER BY us, event_id) AS d FROM t WHERE ns >= 34200000000000 AND ns < 57600000000000)
SELECT t.event_id, coalesce(k.d, 0) AS dt FROM t LEFT JOIN k USING (event_id)""")
def t05(spark, sf_dir):
    """The gap to the symbol's previous event within the day's session; zero for the first and outside of it, without a join:
    events outside go to a window partition of their own."""
    t = events(spark, sf_dir).select((F.col("user_id") % 8).alias("symbol"), "event_id", "us", fn.in_session(F.col("us") % 86_400_000_000 * 1000).alias("inside"))
    d = F.col("us") - F.lag("us").over(series.by("symbol", F.floor(F.col("us") / fn.DAY_US), "inside").orderBy("us", "event_id"))
    return t.select("event_id", F.when(F.col("inside"), F.coalesce(d, F.lit(0))).otherwise(0).cast("long").alias("dt"))


@query("v04_drift_slope", f"WITH {SERIES} SELECT symbol, round(regr_slope(mid, i) * 1000, 6) AS per_thousand, min(i) FILTER (mid < 2) AS first_dead FROM s GROUP BY symbol")
def v04(spark, sf_dir):
    return price_series(spark, sf_dir).groupBy("symbol").agg(F.round(F.regr_slope("mid", "i") * 1000, 6).alias("per_thousand"), F.min(F.when(F.col("mid") < 2, F.col("i"))).alias("first_dead"))


@query("v02_pseudo_clock", f"WITH {SERIES}, k AS (SELECT symbol, i, ts - lag(ts) OVER (PARTITION BY symbol ORDER BY i) AS d FROM s) SELECT symbol, i, CAST(coalesce(sum(d) OVER (PARTITION BY symbol ORDER BY i), 0) AS BIGINT) AS clock FROM k")
def v02(spark, sf_dir):
    w = series.by("symbol").orderBy("i")
    d = price_series(spark, sf_dir).withColumn("d", F.col("ts") - F.lag("ts").over(w))
    return d.select("symbol", "i", F.coalesce(F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).cast("long").alias("clock"))
