"""Order-flow rates for a null model: counts by distance from the opposite best, exposure, sizes, starting point."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lobspark.functions.scalars import DAY_US, OPEN_NS, SESSION_S, TICK, distance_ticks, in_session_us, spread_ticks
from lobspark.operators import book
from lobspark.operators.series import by
from lobspark.sources.tables import checkpointed


def distances(replayed: DataFrame, types: list[str]) -> DataFrame:
    """(locate, side, d, n): the session's messages of the types by their price's distance from the opposite best before
    them. Those that have no opposite best to measure from are counted apart, at a NULL d."""
    w = by("locate").orderBy("us", "seq")
    pre = replayed.select("locate", "us", "msg_type", "side", "price", F.lag("bid").over(w).alias("bid0"), F.lag("ask").over(w).alias("ask0"))
    pre = pre.where(F.col("msg_type").isin(types) & in_session_us(F.col("us")))
    d = distance_ticks(F.col("price"), F.when(F.col("side") == "B", F.col("ask0")).otherwise(F.col("bid0")))
    return pre.groupBy("locate", "side", d.alias("d")).agg(F.count("*").alias("n"))


def counted_clock(rows: DataFrame) -> DataFrame:
    """``rows`` (locate, pos, us) with ``us`` as the time that exposure counts: what has gone by within sessions, each from its
    opening to its last message of the instrument. Between two messages it runs by the later one's part of the session."""
    w = by("locate").orderBy("pos")
    since = F.greatest(F.lag("us").over(w), F.floor(F.col("us") / DAY_US) * DAY_US + OPEN_NS // 1000)
    dt = F.when(in_session_us(F.col("us")), F.col("us") - since).otherwise(0)
    return rows.withColumn("dt", dt.cast("long")).withColumn("us", F.sum("dt").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("dt")


def exposure(messages: DataFrame) -> DataFrame:
    """(locate, side, d, order_seconds): orders at each distance, integrated from each message to the next, within sessions.

    A level counts while the opposite side has a best. A level's orders and the opposite best are constant over stretches
    of messages. Two stretches overlap either because the level's is live when the best's begins, which the tree of
    ``book`` finds, or because it begins within the best's, which is one merge. So the rows are the messages and, for
    each change of a best, the levels that are live then.
    """
    rows = checkpointed(counted_clock(book.level_rows(messages)))  # read several times below
    depth = book.depth_of(rows)
    ends = rows.groupBy("locate").agg(F.max("us").alias("end"))
    w = by("locate", "side", "price").orderBy("pos")
    pieces = rows.select("locate", "side", "price", "orders", "us", "pos", F.coalesce(F.lead("pos").over(w), F.lit(book.endless(depth))).alias("until"), F.lead("us").over(w).alias("to")).where("orders > 0")
    own = by("locate", "side").orderBy("pos")
    facing = F.when(F.col("side") == "B", "S").otherwise("B").alias("side")
    best = book.best_changes(rows).select("locate", facing, "pos", "best")
    moved = best.withColumn("old", F.lag("best").over(own)).where(~F.col("best").eqNullSafe(F.col("old"))).drop("old")
    opp = moved.join(rows.select("locate", "pos", "us").hint("merge"), ["locate", "pos"]).withColumn("o_to", F.lead("us").over(own))
    # stretches of a level that are live when the best changes
    nodes = pieces.select("locate", "side", "price", "orders", "to", F.explode(book.spans("pos", "until", depth)).alias("n")).select("locate", "side", "price", "orders", "to", "n.*")
    asked = opp.where("best IS NOT NULL").select("locate", "side", "best", F.col("us").alias("since"), "o_to", F.explode(book.paths("pos", depth)).alias("n")).select("locate", "side", "best", "since", "o_to", "n.*")
    # by a merge, as above: Spark takes the size before rows are exploded for theirs, and would broadcast them
    standing = asked.join(nodes.hint("merge"), ["locate", "side", "l", "node", "salt"]).select("locate", "side", "price", "orders", "best", "since", "to", "o_to")
    # stretches that begin under a best
    both = pieces.select("locate", "side", "pos", "us", F.struct("price", "orders", "to").alias("piece"), F.lit(None).cast("struct<best:bigint,o_to:bigint>").alias("opp"))
    both = both.unionByName(opp.select("locate", "side", "pos", "us", F.lit(None).cast("struct<price:bigint,orders:bigint,to:bigint>").alias("piece"), F.struct("best", "o_to").alias("opp")))
    carried = both.withColumn("opp", F.last("opp", ignorenulls=True).over(own)).where("piece IS NOT NULL AND opp.best IS NOT NULL")
    begun = carried.select("locate", "side", "piece.price", "piece.orders", "opp.best", F.col("us").alias("since"), "piece.to", "opp.o_to")
    held = standing.unionByName(begun).join(ends, "locate")
    seconds = (F.least(F.coalesce("to", "end"), F.coalesce("o_to", "end")) - F.col("since")) / 1_000_000.0
    return held.groupBy("locate", "side", distance_ticks(F.col("price"), F.col("best")).alias("d")).agg(F.sum(F.col("orders") * seconds).alias("order_seconds"))


def session_seconds(messages: DataFrame) -> DataFrame:
    """One row: the seconds of the sessions of all days that have messages."""
    return messages.select(F.floor(F.col("us") / DAY_US).alias("day")).distinct().agg((F.count("*") * SESSION_S).alias("secs"))


def rates(messages: DataFrame, replayed: DataFrame) -> DataFrame:
    """(locate, side, d, lambda, theta): adds per thousand session seconds, 0 at the open-ended distance; cancels per million
    order-seconds, 0 where there are less than one."""
    adds = distances(replayed, ["A", "F"]).where("d IS NOT NULL").withColumnRenamed("n", "adds")
    cancels = distances(replayed, ["X", "D"]).where("d IS NOT NULL").withColumnRenamed("n", "cancels")
    keys = ["locate", "side", "d"]
    out = adds.join(cancels, keys, "full_outer").join(exposure(messages).where("order_seconds > 0"), keys, "full_outer").crossJoin(F.broadcast(session_seconds(messages)))  # one row
    seconds = F.coalesce("order_seconds", F.lit(0.0))
    theta = F.when(seconds < 1, 0.0).otherwise(F.coalesce("cancels", F.lit(0)) / seconds * 1_000_000)
    rate = F.when(F.col("d") <= 100, F.coalesce("adds", F.lit(0)) / F.col("secs") * 1000).otherwise(0.0)
    return out.select(*keys, F.round(rate, 6).alias("lambda"), F.round(theta, 6).alias("theta"))


def market_rates(messages: DataFrame, decisions: DataFrame) -> DataFrame:
    """(symbol, sign, mu): market decisions per thousand session seconds. decisions: of the session's executions."""
    n = decisions.groupBy("symbol", "sign").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(session_seconds(messages))).select("symbol", "sign", F.round(F.col("n") / F.col("secs") * 1000, 6).alias("mu"))  # one row


def start(replayed: DataFrame) -> DataFrame:
    """(p0, half_spread): the upper median of the instruments' opening mids on the tick grid; half the lower median of
    all spreads in ticks, rounded up, one at least.

    Both medians are read from running counts: over a row an instrument, and over a row a distinct spread.
    """
    both = replayed.where("bid IS NOT NULL AND ask IS NOT NULL")
    opening = both.groupBy("locate").agg(F.min_by(F.floor((F.col("bid") + F.col("ask")) / 2), "seq").alias("x"))
    hist = both.groupBy(spread_ticks(F.col("bid"), F.col("ask")).alias("x")).agg(F.count("*").alias("c"))
    rows = opening.select(F.lit("mid").alias("what"), "x", F.lit(1).cast("long").alias("c")).unionByName(hist.select(F.lit("spread").alias("what"), "x", "c"))
    w = by("what").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.select("what", "x", F.sum("c").over(w).alias("run"), F.sum("c").over(by("what")).alias("total"))
    mid = F.min(F.when((F.col("what") == "mid") & (F.col("run") > F.floor(F.col("total") / 2)), F.col("x")))
    spread = F.min(F.when((F.col("what") == "spread") & (2 * F.col("run") >= F.col("total")), F.col("x")))
    return run.agg((F.floor(mid / TICK) * TICK).alias("p0"), F.greatest(F.lit(1), F.floor((spread + 1) / 2)).alias("half_spread"))


def placements(messages: DataFrame) -> DataFrame:
    """(locate, placement, adds): where an add's price lies among its side's live levels just before it."""
    rows = checkpointed(book.level_rows(messages))  # read several times below
    adds = rows.where(F.col("msg_type").isin(book.ADDS)).select("locate", "pos")
    at = book.places(rows).join(adds, ["locate", "pos"])
    kind = F.when(F.col("n_levels") == 0, "NoSide").when(F.col("same") > 0, "AtLevel").when(F.col("better") == 0, "Inside").when(F.col("better") == F.col("n_levels"), "NewBottom").otherwise("NewInterior")
    return at.groupBy("locate", kind.alias("placement")).agg(F.count("*").alias("adds"))
