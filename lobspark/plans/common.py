"""Inputs of the queries: the events table as price series, fills, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lobspark.operators import series


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "user_id", "event_type", "value")


def price_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, i, ts, seq, mid): value + 1 as a price, in microseconds."""
    e = events(spark, sf_dir)
    return series.ordered(e.select((F.col("user_id") % 8).alias("symbol"), F.col("us").alias("ts"), F.col("event_id").alias("seq"), (F.col("value") + 1).alias("mid")), "ts", "seq")


def coarse_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with mids rounded to tens, so that neighbours are often equal."""
    return coarsened(price_series(spark, sf_dir))


def coarsened(prices: DataFrame) -> DataFrame:
    return prices.withColumn("mid", F.floor(F.col("mid") / 10) * 10.0 + 1)


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, seq, sign, shares): purchases and errors as fills."""
    e = events(spark, sf_dir).where("event_type IN ('purchase', 'error')")
    return e.select(
        (F.col("user_id") % 8).alias("symbol"),
        F.col("us").alias("ts"),
        F.col("event_id").alias("seq"),
        F.when(F.floor(F.col("event_id") / 3) % 2 == 0, 1).otherwise(-1).cast("long").alias("sign"),
        (100 * (1 + F.col("event_id") % 10)).alias("shares"),
    )


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


HOUR = 3_600_000_000

EV = "ev AS (SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value FROM events)"
SERIES = f"{EV}, s AS (SELECT user_id % 8 AS symbol, us AS ts, event_id AS seq, value + 1 AS mid, row_number() OVER (PARTITION BY user_id % 8 ORDER BY us, event_id) AS i FROM ev)"
COARSE = f"{SERIES}, c AS (SELECT symbol, ts, seq, i, floor(mid / 10) * 10.0 + 1 AS mid FROM s)"
RETURNS = f"{SERIES}, r0 AS (SELECT symbol, i, ln(mid / lag(mid) OVER (PARTITION BY symbol ORDER BY i)) AS r FROM s), r AS (SELECT * FROM r0 WHERE r IS NOT NULL)"
FILLS = f"{EV}, f AS (SELECT user_id % 8 AS symbol, us AS ts, event_id AS seq, CASE WHEN (event_id // 3) % 2 = 0 THEN 1 ELSE -1 END AS sign, 100 * (1 + event_id % 10) AS shares FROM ev WHERE event_type IN ('purchase', 'error'))"


def decisions_sql(window: int | str, name: str = "dec") -> str:
    return f"""{name}0 AS (SELECT *, CASE WHEN lag(sign) OVER w IS NULL OR lag(sign) OVER w <> sign OR ts - lag(ts) OVER w > {window} THEN 1 ELSE 0 END AS fresh FROM f WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)),
{name}1 AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY ts, seq) AS decision FROM {name}0),
{name} AS (SELECT symbol, CAST(decision AS BIGINT) AS decision, CAST(min(sign) AS BIGINT) AS sign, min(ts) AS ts, count(*) AS fills, CAST(sum(shares) AS BIGINT) AS shares FROM {name}1 GROUP BY symbol, decision)"""


def acf_sql(source: str, lags: str, value: str = "r") -> str:
    """Lag by lag over a self-join of the numbered values; lags: a SQL list."""
    return f"""m AS (SELECT symbol, avg({value}) AS m, count(*) AS n FROM {source} GROUP BY symbol),
d AS (SELECT symbol, i, {value} - m AS d, n FROM {source} JOIN m USING (symbol)),
v AS (SELECT symbol, max(n) AS n, sum(d * d) AS s2 FROM d GROUP BY symbol),
pairs AS (SELECT a.symbol, k AS lag, sum(a.d * b.d) AS s FROM (SELECT *, unnest({lags}) AS k FROM d) a JOIN d b ON a.symbol = b.symbol AND a.i - a.k = b.i GROUP BY ALL),
acf AS (SELECT symbol, CAST(lag AS BIGINT) AS lag, s / s2 AS acf, n FROM pairs JOIN v USING (symbol) WHERE n >= 3 AND s2 > 0)"""


def curve_sql(source: str, lags: str, value: str = "r") -> str:
    """The same as a subquery."""
    return f"(WITH {acf_sql(source, lags, value)} SELECT symbol, lag, acf, n FROM acf)"


def hill_sql(source: str) -> str:
    """(symbol, n, k, alpha) of the r of a source, as a subquery."""
    return f"""(WITH h0 AS (SELECT symbol, abs(r) AS a, row_number() OVER (PARTITION BY symbol ORDER BY abs(r) DESC) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM {source} WHERE r <> 0),
h1 AS (SELECT *, greatest(10, CAST(floor(0.05 * n) AS BIGINT)) AS k FROM h0),
h2 AS (SELECT symbol, max(n) AS n, max(k) AS k, max(CASE WHEN rn = k + 1 THEN a END) AS edge FROM h1 GROUP BY symbol)
SELECT symbol, max(h2.n) AS n, max(h2.k) AS k, CASE WHEN max(h2.n) >= 20 THEN max(h2.k) / sum(ln(a / edge)) END AS alpha FROM h1 JOIN h2 USING (symbol) WHERE rn <= h2.k GROUP BY symbol)"""
