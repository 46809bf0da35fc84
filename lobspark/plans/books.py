"""Queries over order books rebuilt from the feed that is derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lobspark.functions import scalars as fn
from lobspark.operators import book, calibration, fold, series, stats
from lobspark.sources.tables import checkpointed
from lobspark.plans.common import HOUR, curve_sql, decisions_sql, events, hill_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


DAY = fn.DAY_US


def in_session_sql(us: str) -> str:
    return f"(({us}) % {DAY} * 1000 >= {fn.OPEN_NS} AND ({us}) % {DAY} * 1000 < {fn.CLOSE_NS})"


IN_SESSION = in_session_sql("us")


def feed(spark, sf_dir):
    return book.derived_feed(events(spark, sf_dir))


def replayed(spark, sf_dir, depth=False, ranks=False):
    """The book after each message; the feed has no rejects, so relations will do."""
    return book.replay(feed(spark, sf_dir), depth, ranks)


FEED = """e0 AS (SELECT user_id % 8 + 1 AS locate, event_id AS seq, epoch_us(ts) AS us, event_type, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents, CASE WHEN event_type IN ('signup', 'click', 'view') THEN 'add' ELSE 'take' END AS kind FROM events),
e AS (SELECT *, row_number() OVER (PARTITION BY locate, kind ORDER BY us, seq) AS k FROM e0),
adds AS (SELECT locate, seq, us, CASE WHEN event_type = 'view' THEN 'F' ELSE 'A' END AS msg_type, seq AS order_ref, CASE WHEN seq % 2 = 0 THEN 'B' ELSE 'S' END AS side, 100 * (1 + seq % 10) AS shares,
  CASE WHEN seq % 2 = 0 THEN 1000000 - 100 * (1 + cents % 20) ELSE 1000000 + 100 * (1 + cents % 20) END AS price, k FROM e WHERE kind = 'add'),
takes AS (SELECT e.locate, e.seq, e.us, CASE WHEN event_type = 'purchase' THEN 'E' WHEN e.seq % 3 = 0 THEN 'X' ELSE 'D' END AS msg_type, order_ref,
  CASE WHEN (event_type = 'purchase' AND e.seq % 2 = 0) OR (event_type <> 'purchase' AND e.seq % 3 <> 0) THEN a.shares ELSE a.shares // 2 END AS shares
  FROM e JOIN adds a ON e.locate = a.locate AND e.k = a.k WHERE e.kind = 'take' AND (a.us < e.us OR (a.us = e.us AND a.seq < e.seq))),
msg AS (SELECT locate, seq, us, msg_type, order_ref, side, shares, price FROM adds UNION ALL SELECT locate, seq, us, msg_type, order_ref, NULL, shares, NULL FROM takes),
life0 AS (SELECT m.locate, m.seq, m.us, m.msg_type, m.order_ref, a.side, a.price, m.shares, CASE WHEN m.msg_type IN ('A', 'F') THEN m.shares ELSE -m.shares END AS d FROM msg m JOIN adds a ON m.locate = a.locate AND m.order_ref = a.order_ref),
life AS (SELECT *, CAST(sum(d) OVER (PARTITION BY locate, order_ref ORDER BY us, seq) AS BIGINT) AS after FROM life0),
delta AS (SELECT locate, seq, us, side, price, d, CASE WHEN msg_type IN ('A', 'F') THEN 1 WHEN after = 0 THEN -1 ELSE 0 END AS orders FROM life),
lv AS (SELECT locate, side, price, seq, us, CAST(sum(d) OVER w AS BIGINT) AS shares, CAST(sum(orders) OVER w AS BIGINT) AS orders FROM delta WINDOW w AS (PARTITION BY locate, side, price ORDER BY us, seq))"""

#: The touch after each message, from the last state of every level.
BBO = """lk AS (SELECT DISTINCT locate, side, price FROM lv),
at0 AS (SELECT m.locate, m.seq, k.side, k.price FROM msg m JOIN lk k ON m.locate = k.locate),
at1 AS (SELECT at0.locate, at0.seq, at0.side, at0.price, lv.shares, lv.orders FROM at0 ASOF JOIN lv ON at0.locate = lv.locate AND at0.side = lv.side AND at0.price = lv.price AND at0.seq >= lv.seq),
bbo AS (SELECT m.locate, m.seq, any_value(m.us) AS us, max(CASE WHEN side = 'B' AND shares > 0 THEN price END) AS bid, min(CASE WHEN side = 'S' AND shares > 0 THEN price END) AS ask,
  max_by(shares, price) FILTER (side = 'B' AND shares > 0) AS bid_shares, min_by(shares, price) FILTER (side = 'S' AND shares > 0) AS ask_shares,
  CAST(coalesce(sum(orders), 0) AS BIGINT) AS open_orders, count(*) FILTER (shares > 0) AS levels FROM (SELECT locate, seq, us FROM msg) m LEFT JOIN at1 USING (locate, seq) GROUP BY m.locate, m.seq),
pre AS (SELECT *, lag(bid) OVER w AS bid0, lag(ask) OVER w AS ask0, lag(us) OVER w AS us0 FROM bbo WINDOW w AS (PARTITION BY locate ORDER BY us, seq))"""


@query("s24_derived_feed", f"WITH {FEED} SELECT * FROM msg")
def s24(spark, sf_dir):
    return feed(spark, sf_dir)


@query("b02_lifecycle", f"WITH {FEED} SELECT locate, seq, msg_type, order_ref, side, price, after - d AS before, after FROM life")
def b02(spark, sf_dir):
    return book.lifecycle(feed(spark, sf_dir)).select("locate", "seq", "msg_type", "order_ref", "side", "price", "before", "after")


@query("b09_level_states", f"WITH {FEED} SELECT locate, side, price, seq, shares, orders FROM lv")
def b09(spark, sf_dir):
    return book.level_states(feed(spark, sf_dir)).drop("us")


@query("b16_ledger", f"WITH {FEED} SELECT locate, CAST(sum(CASE WHEN msg_type IN ('A', 'F') THEN shares ELSE 0 END) AS BIGINT) AS added, CAST(sum(CASE WHEN msg_type = 'E' THEN shares ELSE 0 END) AS BIGINT) AS executed, CAST(sum(CASE WHEN msg_type IN ('X', 'D') THEN shares ELSE 0 END) AS BIGINT) AS canceled, CAST(sum(d) AS BIGINT) AS resting FROM life GROUP BY locate")
def b16(spark, sf_dir):
    return book.ledger(feed(spark, sf_dir))


@query("b17_order_history", f"WITH {FEED} SELECT locate, order_ref, row_number() OVER (PARTITION BY locate, order_ref ORDER BY us, seq) AS n, seq, msg_type FROM msg")
def b17(spark, sf_dir):
    n = F.row_number().over(series.by("locate", "order_ref").orderBy("us", "seq")).cast("long")
    return feed(spark, sf_dir).select("locate", "order_ref", n.alias("n"), "seq", "msg_type")


@query("b08_touch_after_message", f"WITH {FEED}, {BBO} SELECT locate, seq, bid, bid_shares, ask, ask_shares, open_orders, levels FROM bbo")
def b08(spark, sf_dir):
    return replayed(spark, sf_dir, depth=True).select("locate", "seq", "bid", "bid_shares", "ask", "ask_shares", "open_orders", "levels")


@query("b14_replay_statistics", f"WITH {FEED} SELECT locate, msg_type, 'Ok' AS result, count(*) AS n FROM msg GROUP BY ALL")
def b14(spark, sf_dir):
    r = fold.replay(feed(spark, sf_dir).withColumn("new_ref", F.lit(None).cast("bigint")))
    return r.groupBy("locate", "msg_type", "result").agg(F.count("*").alias("n"))


@query("b12_invariants", f"WITH {FEED} SELECT locate, count(*) AS messages, CAST(0 AS BIGINT) AS rejects, CAST(0 AS BIGINT) AS crossed, CAST(0 AS BIGINT) AS negative FROM msg GROUP BY locate")
def b12(spark, sf_dir):
    r = fold.replay(feed(spark, sf_dir).withColumn("new_ref", F.lit(None).cast("bigint")))
    return r.groupBy("locate").agg(F.count("*").alias("messages"), F.count_if(F.col("result") != "Ok").alias("rejects"), F.count_if(F.col("bid") >= F.col("ask")).alias("crossed"), F.count_if((F.col("bid_shares") <= 0) | (F.col("ask_shares") <= 0)).alias("negative"))


REJECTS = f"""noise AS (SELECT * FROM (VALUES {", ".join(f"({n[0]}, '{n[1]}', '{n[7]}')" for n in book.NOISE)}) v(k, msg_type, result)),
every AS (SELECT locate, CASE WHEN msg_type = 'E' AND seq % 2 = 0 THEN 'C' ELSE msg_type END AS msg_type, 'Ok' AS result FROM msg UNION ALL SELECT locate, noise.msg_type, result FROM adds JOIN noise ON seq % 8 = noise.k)"""


@query("b14_reject_matrix", f"WITH {FEED}, {REJECTS} SELECT locate, msg_type, result, count(*) AS n FROM every GROUP BY ALL")
def b14_rejects(spark, sf_dir):
    """Results by type, of a feed with rejects of every kind, C and U."""
    return fold.replay(book.noisy_feed(feed(spark, sf_dir))).groupBy("locate", "msg_type", "result").agg(F.count("*").alias("n"))


@query("b05_touch_despite_rejects", f"WITH {FEED}, {BBO} SELECT locate, seq, bid, bid_shares, ask, ask_shares, open_orders FROM bbo")
def b05(spark, sf_dir):
    """What is refused, and what undoes itself, leaves no trace: the book after each message of the plain feed."""
    r = fold.replay(book.noisy_feed(feed(spark, sf_dir))).where("seq % 32 = 0")
    return r.select("locate", (F.col("seq") / 32).cast("long").alias("seq"), "bid", "bid_shares", "ask", "ask_shares", "open_orders")


@query("b13_accepted_replay", f"WITH {FEED}, {REJECTS}, pairs AS (SELECT locate, count(*) FILTER (result = 'Ok' AND msg_type <> 'U') + 2 * count(*) FILTER (result = 'Ok' AND msg_type = 'U') AS messages FROM every GROUP BY locate) SELECT locate, CAST(messages AS BIGINT) AS messages, CAST(0 AS BIGINT) AS different FROM pairs")
def b13(spark, sf_dir):
    """What the fold accepts, with each U as a pair, replayed by relations: the books are the same after each message."""
    noisy = book.noisy_feed(feed(spark, sf_dir))
    held = fold.replay(noisy).where("result = 'Ok'").select("locate", "seq", F.col("side").alias("own"))
    ok = checkpointed(fold.expand_replaces(noisy.join(held, ["locate", "seq"]).withColumn("side", F.coalesce("side", "own")).drop("own")))  # read by both replays
    names = ("bid", "bid_shares", "ask", "ask_shares", "open_orders", "levels", "has_px", "lvl_off")
    a = fold.replay(ok).select("locate", "seq", F.struct(*names).alias("a"))
    b = book.replay(ok).select("locate", "seq", F.struct(*names).alias("b"))
    return a.join(b, ["locate", "seq"], "full_outer").groupBy("locate").agg(F.count("*").alias("messages"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("different"))


@query("b14_peaks", f"WITH {FEED}, {BBO} SELECT locate, max(open_orders) AS peak_open, max(levels) AS peak_levels, last(open_orders ORDER BY seq) AS open_at_end FROM bbo GROUP BY locate")
def b14_peaks(spark, sf_dir):
    return replayed(spark, sf_dir).groupBy("locate").agg(F.max("open_orders").alias("peak_open"), F.max("levels").alias("peak_levels"), F.max_by("open_orders", "seq").alias("open_at_end"))


SNAP = """SELECT locate, side, row_number() OVER (PARTITION BY locate, side ORDER BY CASE WHEN side = 'B' THEN -price ELSE price END, arrival) AS ord, price, order_ref, shares
FROM (SELECT locate, order_ref, any_value(side) AS side, any_value(price) AS price, CAST(sum(d) AS BIGINT) AS shares, min(seq) AS arrival FROM life{} GROUP BY locate, order_ref) WHERE shares > 0"""


@query("s12_final_snapshot", f"WITH {FEED} {SNAP.format('')}")
def s12(spark, sf_dir):
    return book.snapshot(feed(spark, sf_dir))


@query("w01_warm_book", f"WITH {FEED}, cut AS (SELECT min(us) + 864000000000 AS until FROM msg) {SNAP.format(' WHERE us < (SELECT until FROM cut)')}")
def w01(spark, sf_dir):
    """The book ten days after the first message."""
    m = feed(spark, sf_dir)
    return book.snapshot(m, (m.agg(F.min("us")).first()[0] or 0) + 864_000_000_000)


TOUCH = f"""ge AS (SELECT locate, CAST(ceil(min(us) / {HOUR}.0) AS BIGINT) AS a, CAST(floor(max(us) / {HOUR}.0) AS BIGINT) AS b FROM msg GROUP BY locate),
gr AS (SELECT locate, unnest(generate_series(a, b)) * {HOUR} AS t FROM ge WHERE a <= b),
gl AS (SELECT gr.locate, gr.t, k.side, k.price FROM gr JOIN (SELECT DISTINCT locate, side, price FROM lv) k USING (locate)),
gs AS (SELECT gl.locate, gl.t, gl.side, gl.price, x.shares FROM gl ASOF JOIN (SELECT locate, side, price, us, last(shares ORDER BY seq) AS shares FROM lv GROUP BY ALL) x ON gl.locate = x.locate AND gl.side = x.side AND gl.price = x.price AND gl.t > x.us),
touch AS (SELECT gr.locate, gr.t, max(CASE WHEN side = 'B' AND shares > 0 THEN price END) AS bid, max_by(shares, price) FILTER (side = 'B' AND shares > 0) AS bid_shares, min(CASE WHEN side = 'S' AND shares > 0 THEN price END) AS ask, min_by(shares, price) FILTER (side = 'S' AND shares > 0) AS ask_shares FROM gr LEFT JOIN gs USING (locate, t) GROUP BY gr.locate, gr.t)"""


@query("o01_hourly_touch", f"WITH {FEED}, {TOUCH} SELECT * FROM touch")
def o01(spark, sf_dir):
    return book.touch_at(feed(spark, sf_dir), HOUR)


@query("o03_spread_summary", f"""WITH {FEED}, {TOUCH}, q AS (SELECT locate, (ask - bid + 50) // 100 AS sp FROM touch),
k AS (SELECT locate, sp, row_number() OVER (PARTITION BY locate ORDER BY sp) AS rn, count(*) OVER (PARTITION BY locate) AS n FROM q WHERE sp IS NOT NULL),
a AS (SELECT locate, count(*) AS samples, round(avg(sp), 6) AS mean, max(sp) AS widest, round(count(sp) * 100.0 / count(*), 6) AS two_sided FROM q GROUP BY locate)
SELECT a.locate, samples, mean, widest, two_sided, k.sp AS med FROM a LEFT JOIN k ON a.locate = k.locate AND rn - 1 = n // 2""")
def o03(spark, sf_dir):
    t = book.touch_at(feed(spark, sf_dir), HOUR).select("locate", fn.spread_ticks(F.col("bid"), F.col("ask")).alias("sp"))
    a = t.groupBy("locate").agg(F.count("*").alias("samples"), F.round(F.avg("sp"), 6).alias("mean"), F.max("sp").alias("widest"), F.round(F.count("sp") * 100.0 / F.count("*"), 6).alias("two_sided"))
    return a.join(series.upper_median(t, "locate", "sp", "med"), "locate", "left")


@query("y02_event_mids", f"WITH {FEED}, {BBO} SELECT locate, seq, (bid + ask) / 20000.0 AS mid, (ask - bid + 50) // 100 AS spread FROM bbo WHERE bid IS NOT NULL AND ask IS NOT NULL")
def y02(spark, sf_dir):
    """All observations with both sides, at any hour."""
    r = replayed(spark, sf_dir).where("bid IS NOT NULL AND ask IS NOT NULL")
    return r.select("locate", "seq", ((F.col("bid") + F.col("ask")) / 20000.0).alias("mid"), fn.spread_ticks(F.col("bid"), F.col("ask")).alias("spread"))


@query("y13_two_sided_fraction", f"WITH {FEED}, {BBO} SELECT locate, round(avg(CASE WHEN bid IS NOT NULL AND ask IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS two_sided FROM bbo GROUP BY locate")
def y13(spark, sf_dir):
    return replayed(spark, sf_dir).groupBy("locate").agg(F.round(F.avg((F.col("bid").isNotNull() & F.col("ask").isNotNull()).cast("double")), 6).alias("two_sided"))


@query("m05_top_levels", f"WITH {FEED}, z AS (SELECT locate, side, price, CAST(sum(d) AS BIGINT) AS shares, CAST(sum(orders) AS BIGINT) AS orders FROM delta GROUP BY ALL HAVING sum(d) > 0), k AS (SELECT *, row_number() OVER (PARTITION BY locate, side ORDER BY CASE WHEN side = 'B' THEN -price ELSE price END) AS level FROM z) SELECT locate, side, level, price, shares, orders FROM k WHERE level <= 11")
def m05(spark, sf_dir):
    return book.top_levels(feed(spark, sf_dir), 11)


@query("m06_fifo_heads", f"WITH {FEED}, z AS (SELECT locate, order_ref, any_value(side) AS side, any_value(price) AS price, min(seq) AS arrival, sum(d) AS s FROM life GROUP BY ALL) SELECT locate, side, price, min_by(order_ref, arrival) AS head FROM z WHERE s > 0 GROUP BY locate, side, price")
def m06(spark, sf_dir):
    return book.snapshot(feed(spark, sf_dir)).groupBy("locate", "side", "price").agg(F.min_by("order_ref", "ord").alias("head"))


@query("m01_market_sweep", f"""WITH {FEED}, z AS (SELECT locate, order_ref, any_value(price) AS price, CAST(sum(d) AS BIGINT) AS shares, min(seq) AS arrival FROM life WHERE side = 'S' GROUP BY locate, order_ref HAVING sum(d) > 0),
k AS (SELECT *, coalesce(sum(shares) OVER (PARTITION BY locate ORDER BY price, arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM z WHERE price <= 1001500)
SELECT locate, order_ref, price, CAST(least(shares, 25000 - ahead) AS BIGINT) AS shares FROM k WHERE ahead < 25000""")
def m01(spark, sf_dir):
    """A buy of 25,000 shares at up to 100.15 into every final book."""
    asks = book.snapshot(feed(spark, sf_dir)).where("side = 'S'")
    want = asks.select("locate").distinct().select("locate", F.lit(1_001_500).alias("limit"), F.lit(25_000).cast("long").alias("want"))
    return book.sweep(asks, want)


@query("f04_add_reconciliation", f"WITH {FEED} SELECT locate, CAST(sum(CASE WHEN msg_type = 'A' THEN shares ELSE 0 END) AS BIGINT) AS plain, CAST(sum(CASE WHEN msg_type = 'F' THEN shares ELSE 0 END) AS BIGINT) AS attributed, count(*) FILTER (msg_type IN ('A', 'F')) AS orders FROM msg GROUP BY locate")
def f04(spark, sf_dir):
    of = lambda t: F.coalesce(F.sum(F.when(F.col("msg_type") == t, F.col("shares"))), F.lit(0))
    return feed(spark, sf_dir).groupBy("locate").agg(of("A").alias("plain"), of("F").alias("attributed"), F.count_if(F.col("msg_type").isin("A", "F")).alias("orders"))


@query("t01_level_index", f"""WITH {FEED}, {BBO}, p AS (SELECT l.locate, l.seq, l.side, l.price, l.msg_type FROM life l),
prev AS (SELECT locate, seq, coalesce(lag(seq) OVER (PARTITION BY locate ORDER BY us, seq), -1) AS seq0 FROM msg),
o AS (SELECT p.locate, p.seq, count(*) FILTER (a.shares > 0) AS n_levels, count(*) FILTER (a.shares > 0 AND CASE WHEN p.side = 'B' THEN a.price > p.price ELSE a.price < p.price END) AS better, count(*) FILTER (a.shares > 0 AND a.price = p.price) AS same
  FROM p JOIN prev USING (locate, seq) LEFT JOIN at1 a ON a.locate = p.locate AND a.seq = prev.seq0 AND a.side = p.side GROUP BY p.locate, p.seq)
SELECT locate, seq, n_levels > 0 AS has_px, CASE WHEN n_levels = 0 THEN 0 WHEN better = 0 AND same = 0 THEN -1 ELSE better END AS lvl_off FROM o""")
def t01(spark, sf_dir):
    return replayed(spark, sf_dir, ranks=True).select("locate", "seq", "has_px", "lvl_off")


@query("t02_add_placement", f"""WITH {FEED}, {BBO}, p AS (SELECT locate, seq, side, price FROM life WHERE msg_type IN ('A', 'F')),
prev AS (SELECT locate, seq, coalesce(lag(seq) OVER (PARTITION BY locate ORDER BY us, seq), -1) AS seq0 FROM msg),
o AS (SELECT p.locate, p.seq, count(*) FILTER (a.shares > 0) AS n, count(*) FILTER (a.shares > 0 AND CASE WHEN p.side = 'B' THEN a.price > p.price ELSE a.price < p.price END) AS better, count(*) FILTER (a.shares > 0 AND a.price = p.price) AS same
  FROM p JOIN prev USING (locate, seq) LEFT JOIN at1 a ON a.locate = p.locate AND a.seq = prev.seq0 AND a.side = p.side GROUP BY p.locate, p.seq)
SELECT locate, CASE WHEN n = 0 THEN 'NoSide' WHEN same > 0 THEN 'AtLevel' WHEN better = 0 THEN 'Inside' WHEN better = n THEN 'NewBottom' ELSE 'NewInterior' END AS placement, count(*) AS adds FROM o GROUP BY ALL""")
def t02(spark, sf_dir):
    """Where adds land among the levels of the side that are live just before the add."""
    return calibration.placements(feed(spark, sf_dir))


PX = "CASE WHEN opp IS NOT NULL THEN greatest(1, least(101, (abs(price - opp) + 50) // 100)) END"


def _distances(types: str) -> str:
    return f"SELECT l.locate, l.side, l.price, CASE WHEN l.side = 'B' THEN ask0 ELSE bid0 END AS opp FROM life l JOIN pre USING (locate, seq) WHERE msg_type IN ({types}) AND {in_session_sql('l.us')}"


@query("c01_add_distances", f"WITH {FEED}, {BBO}, x AS ({_distances("'A', 'F'")}) SELECT locate, side, CAST({PX} AS BIGINT) AS d, count(*) AS n FROM x GROUP BY ALL")
def c01(spark, sf_dir):
    return calibration.distances(replayed(spark, sf_dir), ["A", "F"])


@query("c02_cancel_distances", f"WITH {FEED}, {BBO}, x AS ({_distances("'X', 'D'")}) SELECT locate, side, CAST({PX} AS BIGINT) AS d, count(*) AS n FROM x GROUP BY ALL")
def c02(spark, sf_dir):
    return calibration.distances(replayed(spark, sf_dir), ["X", "D"])


EXPOSE = f"""nx AS (SELECT locate, seq, bid, ask, CASE WHEN {in_session_sql("next")} THEN next - greatest(us, next // {DAY} * {DAY} + {fn.OPEN_NS // 1000}) ELSE 0 END AS dt FROM (SELECT *, lead(us) OVER (PARTITION BY locate ORDER BY us, seq) AS next FROM bbo)),
ex AS (SELECT a.locate, a.side, greatest(1, least(101, (abs(a.price - CASE WHEN a.side = 'B' THEN ask ELSE bid END) + 50) // 100)) AS d, a.orders * (dt / 1000000.0) AS os
  FROM at1 a JOIN nx USING (locate, seq) WHERE a.orders > 0 AND dt > 0 AND CASE WHEN a.side = 'B' THEN ask ELSE bid END IS NOT NULL),
expo AS (SELECT locate, side, CAST(d AS BIGINT) AS d, sum(os) AS order_seconds FROM ex GROUP BY ALL)"""


@query("c03_exposure", f"WITH {FEED}, {BBO}, {EXPOSE} SELECT locate, side, d, round(order_seconds, 2) AS order_seconds FROM expo")
def c03(spark, sf_dir):
    """From each session's opening to the instrument's last message in it."""
    e = calibration.exposure(feed(spark, sf_dir)).where("order_seconds > 0")
    return e.withColumn("order_seconds", F.round("order_seconds", 2))


EXEC = f"""xe AS (SELECT l.locate AS symbol, l.us AS ts, l.seq, CASE WHEN l.side = 'S' THEN 1 ELSE -1 END AS sign, l.shares FROM life l WHERE msg_type = 'E'),
x0 AS (SELECT *, CASE WHEN lag(sign) OVER w IS NULL OR lag(sign) OVER w <> sign OR ts - lag(ts) OVER w > {HOUR} THEN 1 ELSE 0 END AS fresh FROM xe WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)),
x1 AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY ts, seq) AS decision FROM x0),
xd AS (SELECT symbol, CAST(decision AS BIGINT) AS decision, CAST(min(sign) AS BIGINT) AS sign, min(ts) AS ts, count(*) AS fills, CAST(sum(shares) AS BIGINT) AS shares FROM x1 GROUP BY symbol, decision)"""


def executions(spark, sf_dir):
    """(symbol, ts, seq, sign, shares): the aggressor's sign is + where a sell rested."""
    life = book.lifecycle(feed(spark, sf_dir)).where("msg_type = 'E'")
    return life.select(F.col("locate").alias("symbol"), F.col("us").alias("ts"), "seq", F.when(F.col("side") == "S", 1).otherwise(-1).cast("long").alias("sign"), "shares")


@query("c04_market_decisions", f"WITH {FEED}, {EXEC} SELECT * FROM xd")
def c04(spark, sf_dir):
    return series.decisions(executions(spark, sf_dir), HOUR)


@query("c05_size_histograms", f"WITH {FEED}, {EXEC} SELECT 'add' AS kind, locate AS symbol, side AS key, shares, count(*) AS n FROM adds GROUP BY ALL UNION ALL SELECT 'market', symbol, CASE WHEN sign > 0 THEN 'B' ELSE 'S' END, shares, count(*) FROM xd GROUP BY ALL")
def c05(spark, sf_dir):
    a = feed(spark, sf_dir).where("msg_type IN ('A', 'F')").select(F.lit("add").alias("kind"), F.col("locate").alias("symbol"), F.col("side").alias("key"), "shares")
    m = series.decisions(executions(spark, sf_dir), HOUR).select(F.lit("market").alias("kind"), "symbol", F.when(F.col("sign") > 0, "B").otherwise("S").alias("key"), "shares")
    return a.unionByName(m).groupBy("kind", "symbol", "key", "shares").agg(F.count("*").alias("n"))


SECS = f"secs AS (SELECT {fn.SESSION_S} * count(DISTINCT us // {DAY}) AS secs FROM msg)"


@query("c06_rates", f"""WITH {FEED}, {BBO}, {EXPOSE}, {SECS},
ad AS (SELECT locate, side, CAST({PX} AS BIGINT) AS d, count(*) AS adds FROM ({_distances("'A', 'F'")}) WHERE opp IS NOT NULL GROUP BY ALL),
cn AS (SELECT locate, side, CAST({PX} AS BIGINT) AS d, count(*) AS cancels FROM ({_distances("'X', 'D'")}) WHERE opp IS NOT NULL GROUP BY ALL)
SELECT locate, side, d, round(CASE WHEN d <= 100 THEN coalesce(adds, 0) / secs * 1000 ELSE 0 END, 6) AS lambda, round(CASE WHEN coalesce(order_seconds, 0) < 1 THEN 0 ELSE coalesce(cancels, 0) / order_seconds * 1000000 END, 6) AS theta
FROM ad FULL JOIN cn USING (locate, side, d) FULL JOIN (SELECT * FROM expo WHERE order_seconds > 0) USING (locate, side, d), secs""")
def c06(spark, sf_dir):
    return calibration.rates(feed(spark, sf_dir), replayed(spark, sf_dir))


@query("c06_market_rates", f"WITH {FEED}, {EXEC.replace("WHERE msg_type = 'E'", f"WHERE msg_type = 'E' AND {in_session_sql('l.us')}")}, {SECS} SELECT symbol, sign, round(count(*) / any_value(secs) * 1000, 6) AS mu FROM xd, secs GROUP BY symbol, sign")
def c06_market(spark, sf_dir):
    """Market decisions of the session, by the aggressor's sign."""
    m = feed(spark, sf_dir)
    took = executions(spark, sf_dir).where(fn.in_session_us(F.col("ts")))
    return calibration.market_rates(m, series.decisions(took, HOUR))


@query("c07_null_model_start", f"""WITH {FEED}, {BBO}, op AS (SELECT locate, min_by((bid + ask) // 2, seq) AS mid FROM bbo WHERE bid IS NOT NULL AND ask IS NOT NULL GROUP BY locate),
ks AS (SELECT mid, row_number() OVER (ORDER BY mid) AS rn, count(*) OVER () AS n FROM op),
sp AS (SELECT (ask - bid + 50) // 100 AS s, count(*) AS c FROM bbo WHERE bid IS NOT NULL AND ask IS NOT NULL GROUP BY 1),
sc AS (SELECT s, sum(c) OVER (ORDER BY s) AS run, sum(c) OVER () AS total FROM sp)
SELECT (SELECT CAST(mid // 100 * 100 AS BIGINT) FROM ks WHERE rn - 1 = n // 2) AS p0, (SELECT CAST(greatest(1, (min(s) + 1) // 2) AS BIGINT) FROM sc WHERE 2 * run >= total) AS half_spread""")
def c07(spark, sf_dir):
    return calibration.start(replayed(spark, sf_dir))


@query("s16_calibration_merge", f"WITH {FEED}, d AS (SELECT locate, side, us // 86400000000 AS day, shares FROM adds), h AS (SELECT day, locate, side, shares, count(*) AS n FROM d GROUP BY ALL) SELECT locate, side, shares, count(*) AS days, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY locate, side, shares")
def s16(spark, sf_dir):
    """Daily histograms, merged by addition."""
    a = feed(spark, sf_dir).where("msg_type IN ('A', 'F')").withColumn("day", F.floor(F.col("us") / 86_400_000_000))
    daily = a.groupBy("day", "locate", "side", "shares").agg(F.count("*").alias("n"))
    return daily.groupBy("locate", "side", "shares").agg(F.count("*").alias("days"), F.sum("n").alias("n"))


@query("c10_stream_merge", f"WITH {FEED} SELECT us, locate, seq, row_number() OVER (PARTITION BY us // 86400000000 ORDER BY us, locate, seq) AS place FROM msg")
def c10(spark, sf_dir):
    """One stream from all instruments' streams, stable at equal times, numbered by day."""
    m = feed(spark, sf_dir)
    parts = [m.where("msg_type IN ('A', 'F')"), m.where("msg_type NOT IN ('A', 'F')")]
    day = F.floor(F.col("us") / 86_400_000_000)
    whole = parts[0].unionByName(parts[1]).withColumn("day", day)
    return whole.select("us", "locate", "seq", F.row_number().over(series.by("day").orderBy("us", "locate", "seq")).cast("long").alias("place"))


def _grid(k: int) -> str:
    step = k * HOUR
    return f"""ga{k} AS (SELECT symbol, CAST(ceil(min(ts) / {step}.0) AS BIGINT) AS a, CAST(floor(max(ts) / {step}.0) AS BIGINT) AS b FROM ev2 GROUP BY symbol),
gb{k} AS (SELECT symbol, unnest(generate_series(a, b)) * {step} AS ts FROM ga{k} WHERE a <= b),
gd{k} AS (SELECT symbol, ts, max(seq) AS seq FROM ev2 GROUP BY symbol, ts), ge{k} AS (SELECT e.symbol, e.ts, e.mid FROM ev2 e JOIN gd{k} d USING (symbol, ts, seq)),
gm{k} AS (SELECT g.symbol, g.ts, e.mid, row_number() OVER (PARTITION BY g.symbol ORDER BY g.ts) AS i FROM gb{k} g ASOF JOIN ge{k} e ON g.symbol = e.symbol AND g.ts >= e.ts),
r{k} AS (SELECT * FROM (SELECT symbol, i, ln(mid / lag(mid) OVER (PARTITION BY symbol ORDER BY i)) AS r FROM gm{k}) WHERE r IS NOT NULL)"""


def _kurt(source: str, name: str) -> str:
    return f"(SELECT symbol, CASE WHEN count(*) >= 4 THEN kurtosis_pop(r) END AS {name} FROM {source} GROUP BY symbol)"


def _at(source: str, lags: dict[int, str], value: str = "r", curve: str | None = None) -> str:
    picked = ", ".join(f"max(CASE WHEN lag = {k} THEN acf END) AS {name}" for k, name in lags.items())
    return f"(SELECT symbol, {picked} FROM {curve or curve_sql(source, str(list(lags)), value)} GROUP BY symbol)"


def _upper(source: str, x: str, name: str) -> str:
    return f"(SELECT symbol, {x} AS {name} FROM (SELECT symbol, {x}, row_number() OVER (PARTITION BY symbol ORDER BY {x}) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM {source}) WHERE rn - 1 = n // 2)"


_ABS = {k: f"acf{k}_absr_" for k in (1, 10, 50, 100)}
_PARTS = [
    "(SELECT symbol, count(*) AS n_event, avg(CASE WHEN r = 0 THEN 1.0 ELSE 0.0 END) AS zero_frac_event FROM r0 GROUP BY symbol)",
    _kurt("r0", "kurt_event"),
    _kurt("rt", "kurt_tick"),
    "(SELECT symbol, count(*) AS n_1s, avg(CASE WHEN r = 0 THEN 1.0 ELSE 0.0 END) AS zero_frac_1s FROM r1 GROUP BY symbol)",
    _kurt("r1", "kurt_1s"),
    _kurt("(SELECT * FROM r1 WHERE r <> 0)", "kurt_1s_nonzero"),
    _kurt("r10", "kurt_10s"),
    _kurt("r60", "kurt_60s"),
    f"(SELECT symbol, alpha AS hill_event FROM {hill_sql('r0')})",
    f"(SELECT symbol, alpha AS hill_1s FROM {hill_sql('r1')})",
    _at("r0", {1: "acf1_r_event"}),
    _at("r1", {1: "acf1_r_1s"}),
    _at("a1", {k: name + "1s" for k, name in _ABS.items()}, "a"),
    "(SELECT symbol, count(*) AS n_tick FROM rt GROUP BY symbol)",
    _at("atk", {k: name + "tick" for k, name in _ABS.items()}, "a"),
    "(SELECT symbol, count(*) AS n_signs FROM dec GROUP BY symbol)",
    _at("", {k: f"acf{k}_sign" for k in (1, 10, 100, 1000)}, curve="sc"),
    "(SELECT symbol, CASE WHEN count(*) >= 5 THEN regr_slope(ln(acf), ln(lag)) END AS sign_loglog_slope FROM sc WHERE acf > 1e-12 AND lag <= 100 GROUP BY symbol)",
    _upper("ev2", "spread", "med_spread_ticks"),
    _upper("ev2", "mid", "med_mid"),
    "(SELECT symbol, count(*) AS n_exec FROM f GROUP BY symbol)",
    """(WITH d0 AS (SELECT symbol, a, avg(a) OVER (PARTITION BY symbol) AS m FROM atk), d1 AS (SELECT symbol, m, (a - m) * (a - m) AS d2, row_number() OVER (PARTITION BY symbol ORDER BY (a - m) * (a - m) DESC) AS rn FROM d0)
SELECT symbol, CASE WHEN count(*) >= 20 AND sum(d2) > 0 THEN sqrt(sum(d2) / count(*)) / max(m) END AS cv_absr_tick, CASE WHEN count(*) >= 20 AND sum(d2) > 0 THEN sum(CASE WHEN rn <= 10 THEN d2 ELSE 0 END) / sum(d2) END AS vartop10_absr_tick FROM d1 GROUP BY symbol)""",
]
_COUNTS = [c for c in stats.SUMMARY if c.startswith("n_")]
_SHOWN = ", ".join("symbol" if c == "symbol" else f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" if c in _COUNTS else f"round(CAST({'0.01 / med_mid * 10000' if c == 'rel_tick_bp' else c} AS DOUBLE), 6) AS {c}" for c in stats.SUMMARY)
Y16_SQL = f"""WITH {FEED}, {BBO}, obs AS (SELECT locate AS symbol, us AS ts, seq, bid, ask FROM bbo WHERE {IN_SESSION}),
ev2 AS (SELECT symbol, ts, seq, (bid + ask) / 20000.0 AS mid, (ask - bid + 50) // 100 AS spread, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS i FROM obs WHERE bid IS NOT NULL AND ask IS NOT NULL),
r0 AS (SELECT * FROM (SELECT symbol, i, ln(mid / lag(mid) OVER (PARTITION BY symbol ORDER BY i)) AS r FROM ev2) WHERE r IS NOT NULL),
t0 AS (SELECT *, lag(mid) OVER (PARTITION BY symbol ORDER BY i) AS last FROM ev2), t1 AS (SELECT symbol, mid, row_number() OVER (PARTITION BY symbol ORDER BY i) AS i FROM t0 WHERE last IS NULL OR mid <> last),
rt AS (SELECT * FROM (SELECT symbol, i, ln(mid / lag(mid) OVER (PARTITION BY symbol ORDER BY i)) AS r FROM t1) WHERE r IS NOT NULL),
{_grid(1)}, {_grid(10)}, {_grid(60)}, a1 AS (SELECT symbol, i, abs(r) AS a FROM r1), atk AS (SELECT symbol, i, abs(r) AS a FROM rt),
f AS (SELECT locate AS symbol, us AS ts, seq, CASE WHEN side = 'S' THEN 1 ELSE -1 END AS sign, shares FROM life WHERE msg_type = 'E' AND {IN_SESSION}), {decisions_sql(HOUR)},
sg AS (SELECT symbol, decision AS i, CAST(sign AS DOUBLE) AS r FROM dec), sc AS (SELECT * FROM {curve_sql('sg', 'range(1, 1001)')} WHERE lag <= least(1000, n // 4))
SELECT {_SHOWN} FROM (SELECT symbol, count(*) AS n_msgs_w, avg(CASE WHEN bid IS NOT NULL AND ask IS NOT NULL THEN 1.0 ELSE 0.0 END) AS twosided_frac FROM obs GROUP BY symbol) {" ".join(f"LEFT JOIN {p} p{i} USING (symbol)" for i, p in enumerate(_PARTS))}"""


@query("y16_summary", Y16_SQL)
def y16(spark, sf_dir):
    """All columns of the summary, over the session's messages of the book; the grids' step is an hour here."""
    inside = fn.in_session(F.col("us") % DAY * 1000)
    touch = replayed(spark, sf_dir).where(inside).select(F.col("locate").alias("symbol"), F.col("us").alias("ts"), "seq", "bid", "ask")
    took = executions(spark, sf_dir).where(fn.in_session(F.col("ts") % DAY * 1000))
    out = stats.summary(checkpointed(touch), checkpointed(took), HOUR, HOUR)
    return out.withColumns({c: F.round(c, 6) for c in stats.SUMMARY if c != "symbol" and not c.startswith("n_")})
