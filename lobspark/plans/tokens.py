"""Queries of the event tokenizer, verdict tables and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from lobspark.functions import scalars as fn
from lobspark.operators import ablation, actions, book, fold, series, stats, verdicts
from lobspark.operators import tokens as tk
from lobspark.plans.books import BBO, DAY, FEED, IN_SESSION, feed, replayed
from lobspark.plans.common import EV, FILLS, HOUR, RETURNS, SERIES, acf_sql, events, fills, price_series
from lobspark.plans.market import VARTOP, returns
from lobspark.sources import frames, splits, tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def adds_of(spark, sf_dir):
    """(symbol, size, dt): orders with the gap to the instrument's order before."""
    m = feed(spark, sf_dir).where("msg_type IN ('A', 'F')")
    return m.select(F.col("locate").alias("symbol"), "seq", "us", F.col("shares").alias("size"), F.coalesce(F.col("us") - F.lag("us").over(series.by("locate").orderBy("us", "seq")), F.lit(0)).alias("dt"))


ADDS = "oa AS (SELECT locate AS symbol, seq, us, shares AS size, coalesce(us - lag(us) OVER (PARTITION BY locate ORDER BY us, seq), 0) AS dt FROM adds)"
#: Bumping as one pass: an edge is at least its rank above 2 and above each earlier edge by their distance in rank.
BUMP = "list_transform(range(1, len(raw) + 1), lambda i: list_max(list_transform(range(1, i + 1), lambda j: raw[j] + (i - j)) || [1 + i]))"
SIZES = f"""sr AS (SELECT symbol, size, row_number() OVER (PARTITION BY symbol ORDER BY size) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM oa),
sq AS (SELECT symbol, list(size ORDER BY i) AS raw FROM sr JOIN (SELECT unnest(range(1, 8)) AS i) q ON rn - 1 = CAST(floor(i / 8.0::DOUBLE * (n - 1) + 0.5) AS BIGINT) GROUP BY symbol),
se AS (SELECT symbol, {BUMP} AS edges FROM sq)"""
GAPS = f"""gr AS (SELECT symbol, dt, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM oa WHERE dt > 0),
gl AS (SELECT symbol, max(CASE WHEN rn - 1 = CAST(floor(0.001::DOUBLE * (n - 1) + 0.5) AS BIGINT) THEN dt END) AS lo, max(CASE WHEN rn - 1 = CAST(floor(0.999::DOUBLE * (n - 1) + 0.5) AS BIGINT) THEN dt END) AS hi FROM gr GROUP BY symbol),
gq AS (SELECT symbol, list_transform(range(0, 14), lambda i: CAST(floor(exp(ln(lo) + (ln(hi) - ln(lo)) * i / 13) + 0.5) AS BIGINT)) AS raw FROM gl),
ge AS (SELECT symbol, {BUMP} AS edges FROM gq)"""


@query("t09_size_edges", f"WITH {FEED}, {ADDS}, {SIZES} SELECT symbol, array_to_string(edges, ',') AS edges FROM se")
def t09(spark, sf_dir):
    return tk.size_edges(adds_of(spark, sf_dir), "size").select("symbol", F.array_join(F.col("edges").cast("array<string>"), ",").alias("edges"))


@query("t10_gap_edges", f"WITH {FEED}, {ADDS}, {GAPS} SELECT symbol, array_to_string(edges, ',') AS edges FROM ge")
def t10(spark, sf_dir):
    return tk.gap_edges(adds_of(spark, sf_dir), "dt").select("symbol", F.array_join(F.col("edges").cast("array<string>"), ",").alias("edges"))


@query("t12_pooled_edges", f"WITH {FEED}, {ADDS.replace('locate AS symbol', '0 AS symbol')}, {SIZES} SELECT CAST(symbol AS BIGINT) AS symbol, array_to_string(edges, ',') AS edges FROM se")
def t12(spark, sf_dir):
    """All instruments pooled."""
    pooled = adds_of(spark, sf_dir).withColumn("symbol", F.lit(0).cast("long"))
    return tk.size_edges(pooled, "size").select("symbol", F.array_join(F.col("edges").cast("array<string>"), ",").alias("edges"))


EDGE_CASES = [[1, 1, 100, 100, 101], [100, 200, 300], [5], [2, 3, 3], []]


@query("t11_edge_invariant", "WITH c AS (SELECT unnest([1, 2, 3, 4, 5]) AS id, unnest([[1, 1, 100, 100, 101], [100, 200, 300], [5], [2, 3, 3], []::BIGINT[]]) AS raw) SELECT CAST(id AS BIGINT) AS id, array_to_string(" + BUMP + ", ',') AS bumped, len(raw) >= 2 AND len(list_filter(range(1, len(raw)), lambda i: raw[i] >= raw[i + 1])) = 0 AS valid FROM c")
def t11(spark, sf_dir):
    df = spark.createDataFrame([(i + 1, e) for i, e in enumerate(EDGE_CASES)], "id long, raw array<bigint>")
    return df.select("id", F.array_join(fn.bumped_edges(F.col("raw")).cast("array<string>"), ",").alias("bumped"), fn.valid_edges(F.col("raw")).alias("valid"))


def tokenized(spark, sf_dir, all_hours=False, more=()):
    """The session's events of the replayed feed with their tokens. A gap is that to the event before in the same session.

    What happens outside of the session changes the book, but makes no tokens and is no event that a gap begins at. With
    ``all_hours`` it makes tokens, too, with a gap of zero: every event of the feed, as runs need that rebuild a book from tokens alone. more: columns of the replay to keep.
    """
    r = replayed(spark, sf_dir, ranks=True)
    etype = F.when(F.col("msg_type").isin("A", "F"), "Add").when(F.col("msg_type") == "E", "ExecVisible").when(F.col("msg_type") == "X", "PartialCancel").otherwise("Delete")
    r = r.withColumns({"day": F.floor(F.col("us") / DAY), "inside": fn.in_session_us(F.col("us"))})
    gap = F.col("us") - F.lag("us").over(series.by("locate", "day", "inside").orderBy("us", "seq"))
    dt = F.when(F.col("inside"), F.coalesce(gap, F.lit(0))).otherwise(0).cast("long")
    r = r.withColumn("dt", dt).where("inside" if not all_hours else "true")
    e = r.select(F.col("locate").alias("symbol"), "seq", "us", etype.alias("etype"), "side", "has_px", "lvl_off", F.col("shares").alias("size"), "dt", *more)
    a = adds_of(spark, sf_dir)
    edges = tk.size_edges(a, "size").withColumnRenamed("edges", "size_edges").join(tk.gap_edges(a, "dt").withColumnRenamed("edges", "dt_edges"), "symbol")
    return tk.encode(e.join(edges, "symbol"))


TOKENS = f"""{ADDS}, {SIZES}, {GAPS}, prev AS (SELECT locate, seq, coalesce(lag(seq) OVER w, -1) AS seq0, inside, CASE WHEN inside THEN coalesce(us - lag(us) OVER s, 0) ELSE 0 END AS dt FROM (SELECT *, us // {DAY} AS day, {IN_SESSION} AS inside FROM msg) WINDOW w AS (PARTITION BY locate ORDER BY us, seq), s AS (PARTITION BY locate, day, inside ORDER BY us, seq)),
o AS (SELECT p.locate, p.seq, count(*) FILTER (a.shares > 0) AS n, count(*) FILTER (a.shares > 0 AND CASE WHEN p.side = 'B' THEN a.price > p.price ELSE a.price < p.price END) AS better, count(*) FILTER (a.shares > 0 AND a.price = p.price) AS same
  FROM life p JOIN prev USING (locate, seq) LEFT JOIN at1 a ON a.locate = p.locate AND a.seq = prev.seq0 AND a.side = p.side GROUP BY p.locate, p.seq),
evs AS (SELECT l.locate AS symbol, l.seq, l.us, l.msg_type, l.side, n > 0 AS has_px, CASE WHEN n = 0 THEN 0 WHEN better = 0 AND same = 0 THEN -1 ELSE better END AS off, CASE WHEN l.msg_type = 'D' THEN -l.d ELSE l.shares END AS size, prev.dt, se.edges AS es, ge.edges AS eg
  FROM life l JOIN prev USING (locate, seq) JOIN o USING (locate, seq) JOIN se ON se.symbol = l.locate JOIN ge ON ge.symbol = l.locate WHERE prev.inside),
tok AS (SELECT *, CASE WHEN msg_type IN ('A', 'F') THEN 7 WHEN msg_type = 'E' THEN 10 WHEN msg_type = 'X' THEN 8 ELSE 9 END AS t1, CASE WHEN side = 'B' THEN 13 ELSE 14 END AS t2,
  CASE WHEN NOT has_px THEN 0 WHEN off > 10 THEN 27 ELSE off + 16 END AS t3, 28 + len(list_filter(es, lambda x: x <= size)) AS t4, CASE WHEN dt <= 0 THEN 36 ELSE 37 + len(list_filter(eg, lambda x: x <= dt)) END AS t5 FROM evs)"""


#: The same with the events outside of the session, whose gap is zero.
ALL_TOKENS = TOKENS.replace(" WHERE prev.inside)", ")")


@query("t04_event_tokens", f"WITH {FEED}, {BBO}, {ALL_TOKENS} SELECT symbol, seq, size, dt, concat_ws(' ', t1, t2, t3, t4, t5) AS tokens FROM tok")
def t04(spark, sf_dir):
    """Every event of the feed, at any hour."""
    return tokenized(spark, sf_dir, all_hours=True).select("symbol", "seq", "size", "dt", F.array_join(F.col("tokens").cast("array<string>"), " ").alias("tokens"))


def days(spark, sf_dir):
    """(symbol, day) with a message of the book at any hour: each has a stream."""
    return feed(spark, sf_dir).select(F.col("locate").alias("symbol"), F.floor(F.col("us") / DAY).alias("day")).distinct()


@query("t08_stream_lengths", f"WITH {FEED} SELECT locate AS symbol, us // 86400000000 AS day, 4 + 5 * count(*) FILTER ({IN_SESSION}) AS n_tokens FROM msg GROUP BY ALL")
def t08(spark, sf_dir):
    """How long the daily streams are, with the four session specials; a day without events in its session has these alone."""
    t = tokenized(spark, sf_dir).groupBy("symbol", F.floor(F.col("us") / DAY).alias("day")).agg(F.sum(F.size("tokens")).alias("n"))
    return days(spark, sf_dir).join(t, ["symbol", "day"], "left").select("symbol", "day", (4 + F.coalesce("n", F.lit(0))).cast("long").alias("n_tokens"))


@query("t08_framed_streams", f"""WITH {FEED}, {BBO}, {TOKENS}, z AS (SELECT symbol, us // {DAY} AS day, row_number() OVER (PARTITION BY symbol, us // {DAY} ORDER BY us, seq) AS rn, [t1, t2, t3, t4, t5] AS t FROM tok), n AS (SELECT locate AS symbol, us // {DAY} AS day, count(*) FILTER ({IN_SESSION}) AS n FROM msg GROUP BY ALL)
SELECT symbol, day, CAST(2 + 5 * (rn - 1) + j AS BIGINT) AS place, CAST(t[j + 1] AS BIGINT) AS token FROM z, (SELECT unnest(range(0, 5)) AS j) u
UNION ALL SELECT symbol, day, CAST(CASE WHEN p < 2 THEN p ELSE 5 * n + p END AS BIGINT), CAST([1, 3, 4, 2][p + 1] AS BIGINT) FROM n, (SELECT unnest(range(0, 4)) AS p) u""")
def t08_framed(spark, sf_dir):
    """The daily streams themselves, a row a token."""
    return tk.framed(tokenized(spark, sf_dir).withColumn("day", F.floor(F.col("us") / DAY)), days(spark, sf_dir))


@query("t15_token_inverse", f"WITH {FEED} SELECT locate AS symbol, count(*) AS n, CAST(0 AS BIGINT) AS wrong FROM msg GROUP BY locate")
def t15(spark, sf_dir):
    """Decoding and encoding again gives the same tokens; type, side and near offsets come back exactly. Every event, at any hour."""
    d = tk.decode(tokenized(spark, sf_dir, all_hours=True))
    again = tk.encode(d.select("symbol", F.col("tokens").alias("had"), "etype", "side", "has_px", "lvl_off", F.col("etype_"), F.col("side_"), F.col("off_"), F.col("size_").alias("size"), F.col("dt_").alias("dt"), "size_edges", "dt_edges"))
    wrong = (F.col("tokens") != F.col("had")) | (F.col("etype") != F.col("etype_")) | (F.col("side") != F.col("side_")) | (F.col("has_px") & (F.least(F.col("lvl_off"), F.lit(11)) != F.col("off_")))
    return again.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(wrong).alias("wrong"))


@query("t17_token_shares", f"WITH {FEED}, {BBO}, {ALL_TOKENS}, h AS (SELECT symbol, t3 AS token, count(*) AS n FROM tok GROUP BY ALL) SELECT symbol, CAST(token AS BIGINT) AS token, n, round(n / sum(n) OVER (PARTITION BY symbol), 6) AS share FROM h")
def t17(spark, sf_dir):
    """Of every event, at any hour."""
    h = tokenized(spark, sf_dir, all_hours=True).groupBy("symbol", F.element_at("tokens", 3).alias("token")).agg(F.count("*").alias("n"))
    return h.select("symbol", "token", "n", F.round(F.col("n") / F.sum("n").over(series.by("symbol")), 6).alias("share"))


@query("x06_quantizer_fidelity", f"""WITH {FEED}, {ADDS}, {SIZES}, b AS (SELECT oa.symbol, size, len(list_filter(edges, lambda x: x <= size)) AS b, edges FROM oa JOIN se USING (symbol)),
m AS (SELECT symbol, size, b, CASE WHEN b = 0 THEN edges[1] - 1 ELSE edges[b] END AS rep, avg(size) OVER (PARTITION BY symbol) AS a, avg(size) OVER (PARTITION BY symbol, b) AS mean FROM b)
SELECT symbol, round(1 - sum((size - rep) ** 2) / sum((size - a) ** 2), 6) AS r2_rep, round(1 - sum((size - mean) ** 2) / sum((size - a) ** 2), 6) AS r2_mean, count(DISTINCT b) AS live FROM m GROUP BY symbol""")
def x06(spark, sf_dir):
    a = adds_of(spark, sf_dir)
    b = a.join(tk.size_edges(a, "size"), "symbol").withColumn("b", fn.bucket(F.col("size"), F.col("edges")))
    b = b.withColumn("rep", fn.representative(F.col("b"), F.col("edges")))
    return tk.fidelity(b, "size", "b", "rep").withColumns({"r2_rep": F.round("r2_rep", 6), "r2_mean": F.round("r2_mean", 6)})


@query("x09_total_variation", f"""WITH {FEED}, h AS (SELECT us // 86400000000 AS day, shares, count(*) AS n FROM adds GROUP BY ALL), d AS (SELECT DISTINCT day FROM h), s AS (SELECT DISTINCT shares FROM h),
c AS (SELECT d.day, s.shares, coalesce(h.n, 0) AS n FROM d CROSS JOIN s LEFT JOIN h USING (day, shares)), t AS (SELECT *, sum(n) OVER (PARTITION BY day) AS own, sum(n) OVER (PARTITION BY shares) AS al, sum(n) OVER () AS grand FROM c)
SELECT day, round(0.5 * sum(abs(n / own - (al - n) / (grand - own))), 6) AS tv FROM t GROUP BY day""")
def x09(spark, sf_dir):
    """Each day's order sizes against all other days'."""
    a = feed(spark, sf_dir).where("msg_type IN ('A', 'F')").groupBy(F.floor(F.col("us") / 86_400_000_000).alias("day"), "shares").agg(F.count("*").alias("n"))
    return tk.total_variation(a, "day", "shares", "n").withColumn("tv", F.round("tv", 6))


@query("x11_replace_pairs", f"""WITH {FEED}, p AS (SELECT l.locate, l.msg_type, l.side, lead(msg_type) OVER w AS t2, lead(side) OVER w AS s2, lead(us) OVER w - us AS gap FROM life l WINDOW w AS (PARTITION BY locate ORDER BY us, seq))
SELECT locate, count(*) FILTER (msg_type = 'D') AS deletes, count(*) FILTER (msg_type = 'D' AND t2 IN ('A', 'F') AND s2 = side AND gap <= {HOUR}) AS pairs FROM p GROUP BY locate""")
def x11(spark, sf_dir):
    """Deletes that an add on the same side follows at once (within an hour here)."""
    w = series.by("locate").orderBy("us", "seq")
    p = book.lifecycle(feed(spark, sf_dir)).select("locate", "msg_type", "side", F.lead("msg_type").over(w).alias("t2"), F.lead("side").over(w).alias("s2"), (F.lead("us").over(w) - F.col("us")).alias("gap"))
    gone = F.col("msg_type") == "D"
    return p.groupBy("locate").agg(F.count_if(gone).alias("deletes"), F.count_if(gone & F.col("t2").isin("A", "F") & (F.col("s2") == F.col("side")) & (F.col("gap") <= HOUR)).alias("pairs"))


@query("t07_all_tuples", "SELECT CAST(21504 AS BIGINT) AS n, CAST(21504 AS BIGINT) AS same")
def t07(spark, sf_dir):
    """Encoding what every legal five-token tuple decodes to gives the tuple back."""
    size, dt = [100, 200, 201, 387, 500, 501, 1000], [2**k for k in range(1, 15)]
    n = spark.range(6 * 2 * 14 * 8 * 16).withColumnRenamed("id", "k")
    digit = lambda div, mod: F.floor(F.col("k") / div) % mod
    px = F.when(digit(128, 14) == 13, fn.UNK).otherwise(digit(128, 14) + fn.PX0)
    had = F.array(digit(128 * 28, 6) + fn.TYPE0, digit(128 * 14, 2) + fn.SIDE0, px, digit(16, 8) + fn.SIZE0, digit(1, 16) + fn.DT_ZERO)
    arr = lambda v: F.array(*(F.lit(x).cast("long") for x in v))
    d = tk.decode(n.select(had.cast("array<bigint>").alias("tokens"), arr(size).alias("size_edges"), arr(dt).alias("dt_edges")))
    again = tk.encode(d.select(F.col("tokens").alias("had"), F.col("etype_").alias("etype"), F.col("side_").alias("side"), F.col("off_").isNotNull().alias("has_px"), F.coalesce("off_", F.lit(0)).alias("lvl_off"), F.col("size_").alias("size"), F.col("dt_").alias("dt"), "size_edges", "dt_edges"))
    return again.agg(F.count("*").alias("n"), F.count_if(F.col("tokens") == F.col("had")).alias("same"))


SYM = f"{RETURNS}, {VARTOP}, {acf_sql('r', '[10]')}, per AS (SELECT vt.symbol, vt.n, vartop, acf.acf AS acf10 FROM vt LEFT JOIN acf USING (symbol)), ver AS (SELECT *, CASE WHEN vartop IS NULL OR vartop >= 0.5 THEN 'UNMEASURED' WHEN acf10 > 2 / sqrt(n) THEN 'PRESENT' ELSE 'ABSENT' END AS verdict FROM per)"


def measured(spark, sf_dir):
    r = returns(spark, sf_dir)
    return stats.top_variance(r).join(stats.acf(r, 10).where("lag = 10").select("symbol", F.col("acf").alias("acf10")), "symbol", "left").select("symbol", "n", "vartop", "acf10")


@query("x01_verdicts", f"WITH {SYM} SELECT symbol, verdict FROM ver")
def x01(spark, sf_dir):
    return verdicts.presence(measured(spark, sf_dir)).select("symbol", "verdict")


DAILY = f"""{EV}, z0 AS (SELECT user_id % 8 AS symbol, us // 86400000000 AS day, us, event_id, value + 1 AS mid FROM ev), z1 AS (SELECT symbol, day, abs(ln(mid / lag(mid) OVER (PARTITION BY symbol, day ORDER BY us, event_id))) AS a FROM z0),
zd AS (SELECT symbol, day, count(a) AS n, avg(a) AS m FROM z1 GROUP BY ALL)"""


def daily(spark, sf_dir):
    e = events(spark, sf_dir).select((F.col("user_id") % 8).alias("symbol"), F.floor(F.col("us") / 86_400_000_000).alias("day"), "us", "event_id", (F.col("value") + 1).alias("mid"))
    a = F.abs(F.log(F.col("mid") / F.lag("mid").over(series.by("symbol", "day").orderBy("us", "event_id"))))
    return e.select("symbol", "day", a.alias("a")).groupBy("symbol", "day").agg(F.count("a").alias("n"), F.avg("a").alias("m"))


@query("x02_cross_day_medians", f"WITH {DAILY}, d AS (SELECT day, median(m) AS med FROM zd GROUP BY day) SELECT round(median(med), 6) AS med, round(min(med), 6) AS lo, round(max(med), 6) AS hi, count(*) AS days FROM d")
def x02(spark, sf_dir):
    return verdicts.cross_day(daily(spark, sf_dir), "m")


@query("x03_measurable_days", f"WITH {DAILY}, q AS (SELECT symbol, count(*) FILTER (n >= 30) AS days FROM zd GROUP BY symbol), k AS (SELECT unnest(range(1, 31)) AS k) SELECT k, count(*) FILTER (days >= k) AS symbols FROM q, k GROUP BY k")
def x03(spark, sf_dir):
    return verdicts.measurable(daily(spark, sf_dir).withColumn("ok", F.col("n") >= 30), 30)


@query("x07_null_envelope", f"WITH {DAILY} SELECT symbol, round(quantile_cont(m, 0.1), 6) AS q10, round(quantile_cont(m, 0.9), 6) AS q90, count(m) AS k FROM zd GROUP BY symbol")
def x07(spark, sf_dir):
    return verdicts.envelope(daily(spark, sf_dir), "m")


@query("x08_beat_test", f"""WITH {DAILY}, c AS (SELECT symbol, day, n, m, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS rn FROM zd),
e AS (SELECT symbol, quantile_cont(m, 0.1) AS q10, quantile_cont(m, 0.9) AS q90, count(m) AS k FROM c WHERE rn > 1 GROUP BY symbol)
SELECT c.symbol, CASE WHEN k < 5 OR n < 10 THEN 'INCONCLUSIVE' WHEN m >= q10 AND m <= q90 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM c JOIN e USING (symbol) WHERE rn = 1""")
def x08(spark, sf_dir):
    """The last day against the envelope of the days before."""
    return verdicts.beat(daily(spark, sf_dir))


@query("k05_inverse_cdf", f"""WITH {FILLS}, h AS (SELECT symbol, shares, count(*) AS c FROM f GROUP BY ALL), k AS (SELECT symbol, shares, sum(c) OVER (PARTITION BY symbol ORDER BY shares) AS cum, sum(c) OVER (PARTITION BY symbol) AS total FROM h)
SELECT symbol, CAST(j AS BIGINT) AS j, min(shares) AS drawn FROM k, (SELECT unnest(range(0, 50)) AS j) u WHERE cum >= (j + 0.5) / 50.0 * total GROUP BY symbol, j""")
def k05(spark, sf_dir):
    """Draws by inverse distribution at fixed uniforms: the first value whose running count reaches u times the total."""
    h = fills(spark, sf_dir).groupBy("symbol", "shares").agg(F.count("*").alias("c"))
    return verdicts.inverse_cdf(h, "symbol", "shares", "c", 50)


@query("c08_sampled_sizes", f"""WITH {FILLS}, h AS (SELECT symbol, shares, count(*) AS c FROM f GROUP BY ALL), k AS (SELECT symbol, shares, sum(c) OVER (PARTITION BY symbol ORDER BY shares) AS cum, sum(c) OVER (PARTITION BY symbol) AS total FROM h),
d AS (SELECT s.symbol, j, CAST(('0x' || substr(md5(concat_ws('|', 7, s.symbol, j)), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM (SELECT unnest(range(0, 9)) AS symbol) s, (SELECT unnest(range(0, 500)) AS j) n)
SELECT CAST(d.symbol AS BIGINT) AS symbol, CAST(j AS BIGINT) AS j, CAST(coalesce(min(shares), 100) AS BIGINT) AS drawn FROM d LEFT JOIN k ON d.symbol = k.symbol AND cum >= u * total GROUP BY d.symbol, j""")
def c08(spark, sf_dir):
    """500 seeded draws of every symbol's fill sizes; the ninth symbol has no fills."""
    h = fills(spark, sf_dir).groupBy("symbol", "shares").agg(F.count("*").alias("c"))
    draws = spark.range(9 * 500).select(F.floor(F.col("id") / 500).alias("symbol"), (F.col("id") % 500).alias("j"))
    return verdicts.sampled(h, draws.withColumn("u", verdicts.uniform(7, "symbol", "j")), "shares", "c")


@query("k06_uniform_supply", f"WITH {FILLS}, k AS (SELECT symbol, seq, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS j FROM f) SELECT symbol, seq, CAST(('0x' || substr(md5(concat_ws('|', 42, symbol, j)), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM k")
def k06(spark, sf_dir):
    """A uniform for each fill from a seed, its stream and its place there: the same in chunks of any size."""
    j = F.row_number().over(series.by("symbol").orderBy("ts", "seq"))
    return fills(spark, sf_dir).select("symbol", "seq", j.alias("j")).select("symbol", "seq", verdicts.uniform(42, "symbol", "j").alias("u"))


@query("m07_masked_softmax", f"""WITH {SERIES}, l AS (SELECT symbol, (i - 1) // {fn.VOCABULARY} AS step, (i - 1) % {fn.VOCABULARY} AS token, mid / 10 AS logit FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY symbol, step ORDER BY logit DESC) AS rn FROM l), t AS (SELECT symbol, step, min(logit) AS edge FROM k WHERE rn <= 10 GROUP BY symbol, step),
e AS (SELECT symbol, step, token, exp((logit - max(logit) OVER (PARTITION BY symbol, step)) / 0.8) AS e FROM l JOIN t USING (symbol, step) WHERE logit >= edge) SELECT symbol, step, token, round(e / sum(e) OVER (PARTITION BY symbol, step), 6) AS p FROM e""")
def m07(spark, sf_dir):
    """Every series in steps of a vocabulary's logits. Temperature 0.8, the ten largest and all that tie with the tenth."""
    i = F.col("i") - 1
    logits = price_series(spark, sf_dir).select("symbol", F.floor(i / fn.VOCABULARY).alias("step"), (i % fn.VOCABULARY).alias("token"), (F.col("mid") / 10).alias("logit"))
    return verdicts.masked_softmax(logits, 10, 0.8, ("symbol", "step")).withColumn("p", F.round("p", 6))


@query("p06_body_bytes", f"WITH {FEED} SELECT msg_type, CAST(CASE msg_type WHEN 'A' THEN 36 WHEN 'F' THEN 40 WHEN 'E' THEN 31 WHEN 'X' THEN 23 WHEN 'D' THEN 19 END AS BIGINT) AS body, count(*) AS n FROM msg GROUP BY ALL")
def p06(spark, sf_dir):
    return feed(spark, sf_dir).where(fn.is_book_type(F.col("msg_type"))).groupBy("msg_type", fn.body_length(F.col("msg_type")).alias("body")).agg(F.count("*").alias("n"))


@query("p07_rendered", f"WITH {FEED} SELECT seq, CASE WHEN msg_type IN ('A', 'F') THEN concat(msg_type, ' ', order_ref, ' ', side, ' ', shares, ' @ ', printf('%.4f', price / 10000.0)) WHEN msg_type = 'D' THEN concat('D ', order_ref) ELSE concat(msg_type, ' ', order_ref, ' ', shares) END AS line FROM msg")
def p07(spark, sf_dir):
    return feed(spark, sf_dir).select("seq", fn.rendered().alias("line"))


@query("v01_viability", f"""WITH {FEED}, {BBO}, x AS (SELECT locate, us AS ts, seq, CASE WHEN side = 'S' THEN 1 ELSE -1 END AS sign FROM life WHERE msg_type = 'E'),
g AS (SELECT locate, CASE WHEN lag(sign) OVER w IS NULL OR lag(sign) OVER w <> sign OR ts - lag(ts) OVER w > {HOUR} THEN 1 ELSE 0 END AS fresh FROM x WINDOW w AS (PARTITION BY locate ORDER BY ts, seq)),
s AS (SELECT locate, sum(fresh) AS signs FROM g GROUP BY locate), b AS (SELECT locate, avg(CASE WHEN bid IS NOT NULL AND ask IS NOT NULL THEN 1.0 ELSE 0.0 END) AS two, min(seq) FILTER (open_orders = 0) AS dead FROM bbo GROUP BY locate)
SELECT locate, CAST(signs AS BIGINT) AS signs, signs >= 50 AS v1, two >= 0.9 AS v2, dead IS NULL AS v3, signs >= 50 AND two >= 0.9 AND dead IS NULL AS viable FROM s JOIN b USING (locate)""")
def v01(spark, sf_dir):
    return verdicts.viability(replayed(spark, sf_dir), HOUR, least_signs=50)


def action_stream(spark, sf_dir):
    """Events as actions of eight streams: limits around a mid, market orders, cancels, and some that must be refused."""
    e = events(spark, sf_dir).withColumn("cents", F.floor(F.col("value") * 100 + 0.5))
    kind = F.when(F.col("event_type") == "purchase", "market").when(F.col("event_type") == "error", "cancel").otherwise("limit")
    side = F.when(F.col("event_id") % 2 == 0, "B").otherwise("S")
    price = F.when(kind != "market", 1_000_000 + 100 * (F.col("cents") % 21 - 10) + F.when(F.col("cents") % 97 == 0, 900_000).otherwise(0))
    return e.select((F.col("user_id") % 8).alias("stream"), F.col("event_id").alias("seq"), kind.alias("kind"), side.alias("side"), price.alias("price"), (100 * (F.col("cents") % 11)).alias("shares"))


@query("m04_closed_loop")
def m04(spark, sf_dir):
    """Every action's outcome; sequential, so without SQL: tested against a naive matcher."""
    out = actions.closed_loop(action_stream(spark, sf_dir))
    return out.select("stream", "seq", "kind", "reject", "filled", "rested", "canceled", "bid", "ask", "open_orders")


@query("m08_action_counts", f"WITH {EV} SELECT user_id % 8 AS stream, count(*) AS submitted, CAST(0 AS BIGINT) AS unbalanced FROM ev GROUP BY ALL")
def m08(spark, sf_dir):
    """Applied and rejected together are all; and the journal, replayed, ends at the same book."""
    out = actions.closed_loop(action_stream(spark, sf_dir))
    replay = fold.replay(actions.journal(out)).groupBy(F.col("locate").alias("stream")).agg(F.count_if(F.col("result") != "Ok").alias("bad"), F.max_by("open_orders", "seq").alias("end"))
    own = out.groupBy("stream").agg(F.count("*").alias("submitted"), F.max_by("open_orders", "seq").alias("here"))
    return own.join(replay, "stream", "left").select("stream", "submitted", (F.col("bad") + F.abs(F.col("here") - F.col("end"))).alias("unbalanced"))


@query("h04_token_loop")
def h04(spark, sf_dir):
    """Daily token streams driven against live books: rejects by reason and stream. Sequential, so without SQL."""
    t = tokenized(spark, sf_dir, all_hours=True).withColumn("day", F.floor(F.col("us") / 86_400_000_000))
    body = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("us", "seq", "tokens"))), lambda s: s["tokens"]))
    s = t.groupBy("symbol", "day").agg(body.alias("tokens"), F.first("size_edges").alias("size_edges"), F.first("dt_edges").alias("dt_edges"))
    loop = actions.token_loop(s.withColumn("stream", F.col("symbol") * 100_000 + F.col("day")), 1_000_000)
    return actions.reject_counts(loop)


def ablation_events(spark, sf_dir):
    return tokenized(spark, sf_dir, all_hours=True, more=("order_ref", "price")).withColumnRenamed("symbol", "locate")


@query("r01_ablation_control", f"WITH {FEED} SELECT locate, count(*) AS emitted, CAST(0 AS BIGINT) AS no_order, CAST(0 AS BIGINT) AS zero, CAST(0 AS BIGINT) AS rejected, CAST(0 AS BIGINT) AS clamped, CAST(0 AS BIGINT) AS price_moved, CAST(0 AS BIGINT) AS ref_moved FROM msg GROUP BY locate")
def r01_control(spark, sf_dir):
    """Without any substitution every event is emitted as it was."""
    return ablation.accounting(ablation.ablated(ablation_events(spark, sf_dir), "none"))


@query("r01_ablation_modes")
def r01(spark, sf_dir):
    """All modes' accounts. What a replaced field does to later events depends on the live book: no SQL."""
    e = tables.checkpointed(ablation_events(spark, sf_dir))  # read by each mode
    out = None
    for mode in ("dt", "size", "pxadd", "all", "noref"):
        part = ablation.accounting(ablation.ablated(e, mode)).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


@query("x10_slice_viability")
def x10(spark, sf_dir):
    """Token streams cut into slices of 50 events, each restarted from a seeded book: applied share and the first event
    without orders. Sequential within a slice: no SQL."""
    t = tokenized(spark, sf_dir, all_hours=True).withColumn("slice", F.floor((F.row_number().over(series.by("symbol").orderBy("us", "seq")) - 1) / 50))
    body = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("us", "seq", "tokens"))), lambda s: s["tokens"]))
    s = t.groupBy("symbol", "slice").agg(body.alias("tokens"), F.first("size_edges").alias("size_edges"), F.first("dt_edges").alias("dt_edges"))
    loop = actions.token_loop(s.withColumn("stream", F.col("symbol") * 1_000_000 + F.col("slice")), 1_000_000)
    per = loop.groupBy("stream").agg(F.avg(F.col("reject").isNull().cast("double")).alias("applied"), F.min(F.when(F.col("open_orders") == 0, F.col("seq"))).alias("dead"))
    return per.groupBy(F.floor(F.col("stream") / 1_000_000).alias("symbol")).agg(F.count("*").alias("slices"), F.round(F.avg("applied"), 6).alias("applied"), F.count("dead").alias("died"))


@query("s12_warm_restart", f"WITH {FEED} SELECT locate, count(*) AS messages, CAST(0 AS BIGINT) AS rejects FROM adds GROUP BY locate")
def s12_restart(spark, sf_dir):
    """Each instrument's orders as a snapshot of adds, replayed into an empty book before nothing else: all are taken."""
    m = feed(spark, sf_dir).where("msg_type IN ('A', 'F')")
    rows = book.snapshot(m).select(F.col("locate").cast("string").alias("ticker"), F.row_number().over(series.by("locate").orderBy("side", "ord")).cast("long").alias("ord"), "side", "price", "shares")
    warm = tables.warm_messages(rows.withColumn("order_ref", F.col("ord") - 1 + tables.WARM_REF))
    return fold.replay(warm).groupBy("locate").agg(F.count("*").alias("messages"), F.count_if(F.col("result") != "Ok").alias("rejects"))


@query("p21_token_names", """WITH t AS (SELECT unnest(range(-1, 53)) AS id) SELECT CAST(id AS BIGINT) AS id, CASE WHEN id < 0 OR id > 51 THEN '?' WHEN id < 15 THEN ['UNK', 'BOS', 'EOS', 'SESSION_OPEN', 'SESSION_CLOSE', 'HALT', 'RESUME', 'TYPE_ADD', 'TYPE_CANCEL', 'TYPE_DELETE', 'TYPE_EXEC', 'TYPE_EXEC_HIDDEN', 'TYPE_CROSS', 'SIDE_BID', 'SIDE_ASK'][id + 1]
WHEN id < 27 THEN printf('PX%+d', id - 16) WHEN id = 27 THEN 'PX_TAIL' WHEN id < 36 THEN concat('SZ', id - 28) WHEN id = 36 THEN 'DT_ZERO' WHEN id = 51 THEN 'DT_TAIL' ELSE concat('DT', id - 37) END AS name FROM t""")
def p21(spark, sf_dir):
    return spark.range(-1, 53).select("id", fn.token_name(F.col("id")).alias("name"))


@query("s02_codec_round_trip", f"WITH {FEED} SELECT locate, seq, us * 1000 % 281474976710656 AS ts_ns, msg_type, order_ref, side, CASE WHEN msg_type <> 'D' THEN shares END AS shares, price FROM msg")
def s02(spark, sf_dir):
    """The feed as wire bodies, and decoded again by column expressions."""
    m = feed(spark, sf_dir).withColumn("ts_ns", F.col("us") * 1000 % (1 << 48))
    bodies = frames.encode(m).select(F.lit("feed").alias("path"), "seq", F.lit(0).cast("long").alias("offset"), "msg_type", "body")
    return frames.decode(bodies).where("decode_error IS NULL").select("locate", "seq", "ts_ns", "msg_type", "order_ref", "side", "shares", "price")


@query("s03_frame_sizes", f"WITH {FEED}, b AS (SELECT locate, CASE msg_type WHEN 'A' THEN 36 WHEN 'F' THEN 40 WHEN 'E' THEN 31 WHEN 'X' THEN 23 ELSE 19 END AS n FROM msg) SELECT locate, count(*) AS frames, CAST(sum(n + 2) AS BIGINT) AS bytes FROM b GROUP BY locate")
def s03(spark, sf_dir):
    body = frames.encode(feed(spark, sf_dir))
    return body.groupBy("locate").agg(F.count("body").alias("frames"), F.sum(F.length("body") + 2).alias("bytes"))


@query("s21_split_guard", """WITH p AS (SELECT event_id, concat('/data/', CASE event_id % 5 WHEN 0 THEN 'synthetic' WHEN 1 THEN '20190130' WHEN 2 THEN '20190730' WHEN 3 THEN '20200130' ELSE strftime(ts, '%Y%m%d') END, '-', event_id % 7, '.bin') AS path FROM events)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'OkNotADay' WHEN 1 THEN 'OkTrain' WHEN 2 THEN 'OkVal' WHEN 3 THEN 'TestBlocked' ELSE 'UnknownDay' END AS access, event_id % 5 < 3 AS readable FROM p""")
def s21(spark, sf_dir):
    """Made-up file names of every kind through the guard."""
    k = F.col("event_id") % 5
    day = F.when(k == 0, "synthetic").when(k == 1, "20190130").when(k == 2, "20190730").when(k == 3, "20200130").otherwise(F.date_format(F.timestamp_micros("us"), "yyyyMMdd"))
    path = F.concat(F.lit("/data/"), day, F.lit("-"), (F.col("event_id") % 7).cast("string"), F.lit(".bin"))
    access = splits.split_of(path)
    return events(spark, sf_dir).select("event_id", access.alias("access"), splits.allowed(access).alias("readable"))


@query("t03_replace_pairs", f"""WITH {FEED} SELECT locate, order_ref, count(*) AS events, CAST(max(a.shares) AS BIGINT) AS shares FROM (SELECT locate, order_ref, shares FROM adds UNION ALL SELECT locate, order_ref, shares FROM adds UNION ALL SELECT locate, order_ref + 1000000000, shares FROM adds) a GROUP BY locate, order_ref""")
def t03(spark, sf_dir):
    """Every order replaced once, a moment later, at its own price: an add, then a delete and an add."""
    adds = feed(spark, sf_dir).where("msg_type IN ('A', 'F')").withColumn("new_ref", F.lit(None).cast("bigint"))
    swap = adds.withColumns({"msg_type": F.lit("U"), "new_ref": F.col("order_ref") + 1_000_000_000, "us": F.col("us") + 1, "seq": F.col("seq") + 1_000_000_000})
    both = fold.expand_replaces(adds.unionByName(swap))
    return fold.replay(both).where("result = 'Ok'").groupBy("locate", "order_ref").agg(F.count("*").alias("events"), F.max("shares").alias("shares"))
