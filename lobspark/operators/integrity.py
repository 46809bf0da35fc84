"""Whether books and streams hold together: an audit in one pass, running fingerprints of a book's state, strict replay of
recorded events, and what it says of streams that were changed on purpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lobspark.functions.scalars import DAY_US, in_session_us
from lobspark.operators import book, fold, scan

#: What the audit counts: the first three are sizes, the others violations.
CHECKS = ["levels", "orders", "books", "no_shares", "level_shares", "level_orders", "queue_order", "crossed", "conservation"]


def audited(orders: DataFrame, levels: DataFrame, ledger: DataFrame) -> DataFrame:
    """(name, n): the counts of ``CHECKS``, observed in a single pass.

    orders: resting ones (locate, side, price, order_ref, shares, ord, arrival), ord their place in the book; levels: what the
    book says of each level (locate, side, price, shares, orders); ledger: (locate, added, executed, canceled). A level that
    only one of the two knows violates level_shares and level_orders; orders without arrival violate queue_order.
    """
    queue = Window.partitionBy("locate", "side", "price").orderBy("ord")
    late = F.coalesce(F.col("arrival") <= F.lag("arrival").over(queue), F.col("arrival").isNull())
    each = orders.select("locate", "side", "price", "shares", late.cast("long").alias("late"))
    sums = each.groupBy("locate", "side", "price").agg(F.sum("shares").alias("have"), F.count("*").alias("n"), F.sum("late").alias("late"), F.count_if(F.col("shares") <= 0).alias("none"))
    both = sums.join(levels.select("locate", "side", "price", F.col("shares").alias("said"), F.col("orders").alias("said_n")), ["locate", "side", "price"], "full_outer")
    of = lambda side, f: f(F.when(F.col("side") == side, F.col("price")))
    books = each.groupBy("locate").agg(F.sum("shares").alias("resting"), of("B", F.max).alias("bid"), of("S", F.min).alias("ask"))
    books = ledger.join(books, "locate", "full_outer").select("locate", F.coalesce("resting", F.lit(0)).alias("resting"), "bid", "ask", "added", "executed", "canceled")
    rows = both.withColumn("kind", F.lit("level")).unionByName(books.withColumn("kind", F.lit("book")), allowMissingColumns=True)
    level, of_book = F.col("kind") == "level", F.col("kind") == "book"
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    seen = Observation()
    metrics = {
        "levels": F.count_if(level),
        "orders": total("n"),
        "books": F.count_if(of_book),
        "no_shares": total("none"),
        "level_shares": F.count_if(level & ~F.col("have").eqNullSafe(F.col("said"))),
        "level_orders": F.count_if(level & ~F.col("n").eqNullSafe(F.col("said_n"))),
        "queue_order": total("late"),
        "crossed": F.count_if(of_book & (F.col("bid") >= F.col("ask"))),
        "conservation": F.count_if(of_book & ~F.coalesce(F.col("added") == F.col("resting") + F.col("executed") + F.col("canceled"), F.lit(False))),
    }
    rows.observe(seen, *(metrics[c].cast("long").alias(c) for c in CHECKS)).write.format("noop").mode("overwrite").save()
    got = seen.get
    return orders.sparkSession.createDataFrame([(c, int(got[c])) for c in CHECKS], "name string, n long")


#: Sums of hashes are kept below this, a prime.
PRIME = (1 << 61) - 1


def lane(k: int, *columns: str | Column) -> Column:
    """Forty bits of a hash of the columns, for k = 0, 1, 2."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *columns)), 1 + 10 * k, 10), 16, 10).cast("decimal(20,0)")


def fingerprints(messages: DataFrame) -> DataFrame:
    """(locate, seq, pos, a, b, added, executed, canceled, trail): the state after each message of a feed without rejects.

    a and b are sums of a hash of every live level (side, price, shares, orders): sets of levels are equal where both are, with
    odds of 2**-80 against. A message changes one level, so a running sum keeps them. trail is the running sum of hashes of
    all states so far with their numbers: it tells two replays apart from the first message on where they differ, even if the books are equal again.
    """
    rows = book.level_rows(messages)
    before = (F.col("orders") - F.col("one"), F.col("had"))
    of = lambda k, orders, shares: F.when(orders > 0, lane(k, "side", "price", shares, orders)).otherwise(0)
    change = {name: of(k, F.col("orders"), F.col("shares")) - of(k, *before) for k, name in enumerate("ab")}
    kinds = {"added": ["A", "F"], "executed": ["E", "C"], "canceled": ["X", "D"]}
    ledger = {name: F.when(F.col("msg_type").isin(types), F.col("moved")).otherwise(0).cast("long") for name, types in kinds.items()}
    states = scan.running(rows, ["pos"], change | ledger, ("locate",))
    short = [F.col("locate"), F.col("seq"), F.col("pos"), *(F.pmod(F.col(c), F.lit(PRIME).cast("decimal(20,0)")).cast("long").alias(c) for c in "ab"), *kinds]
    states = states.select(*short)
    trail = lane(0, "pos", "a", "b", *kinds)
    out = scan.running(states, ["pos"], {"trail": trail}, ("locate",))
    return out.withColumn("trail", F.pmod(F.col("trail"), F.lit(PRIME).cast("decimal(20,0)")).cast("long"))


def recorded(messages: DataFrame) -> DataFrame:
    """The event stream of a feed without rejects (locate, place, us, msg_type, order_ref, side, price, size, has_px, lvl_off,
    in_win, dt): gaps are between the events of a day's session, zero for its first and outside."""
    r = book.replay(messages, depth=False).withColumn("in_win", in_session_us(F.col("us")))
    gap = F.col("us") - F.lag("us").over(Window.partitionBy("locate", F.floor(F.col("us") / DAY_US), "in_win").orderBy("pos"))
    dt = F.when(F.col("in_win"), F.coalesce(gap, F.lit(0))).otherwise(0).cast("long")
    return r.select("locate", F.col("pos").alias("place"), "us", "msg_type", "order_ref", "side", "price", F.col("shares").alias("size"), "has_px", "lvl_off", "in_win", dt.alias("dt"))


def mismatches(events: DataFrame) -> DataFrame:
    """``events`` with what a strict replay finds: reject, px, order, dt (booleans) and any of them.

    A fresh book is driven by the events in the order of their places. px: the price's level index just before is not the
    recorded one; order: side, price or (of a delete) size are not the standing order's; dt: not the gap to the event before in the same session.
    """
    as_messages = events.select("locate", F.col("place").alias("seq"), F.col("place").alias("us"), "msg_type", "order_ref", F.lit(None).cast("bigint").alias("new_ref"), "side", F.col("size").alias("shares"), "price")
    fresh = fold.replay(as_messages).select("locate", F.col("seq").alias("place"), "result", F.col("side").alias("own_side"), F.col("price").alias("own_price"), F.col("shares").alias("own_size"), F.col("has_px").alias("own_has"), F.col("lvl_off").alias("own_off"))
    w = Window.partitionBy("locate", F.floor(F.col("us") / DAY_US), "in_win").orderBy("place")
    want = F.when(F.col("in_win"), F.coalesce(F.col("us") - F.lag("us").over(w), F.lit(0))).otherwise(0)
    both = events.withColumn("want", want).join(fresh, ["locate", "place"])
    adding = F.col("msg_type").isin(book.ADDS)
    standing = F.col("side").eqNullSafe(F.col("own_side")) & F.col("price").eqNullSafe(F.col("own_price")) & ((F.col("msg_type") != "D") | F.col("size").eqNullSafe(F.col("own_size")))
    found = {
        "reject": F.col("result") != "Ok",
        "px": (F.col("has_px") != F.col("own_has")) | (F.col("has_px") & (F.col("lvl_off") != F.col("own_off"))),
        "order": ~adding & ~standing,
        "dt_off": F.col("dt") != F.col("want"),
    }
    out = both.withColumns(found)
    return out.select(*events.columns, *found, F.greatest(*found).alias("any"))


#: Ways to change a stream. px, size and dt add one to a field of one event; swap exchanges two neighbours.
MUTATIONS = ["swap", "px", "size", "dt"]


def eligible(events: DataFrame, kind: str) -> DataFrame:
    """The events of which one may be changed in this way."""
    if kind == "swap":
        w = Window.partitionBy("locate").orderBy("place")
        last, ahead = (lambda c: F.lag(c).over(w)), (lambda c: F.lead(c).over(w))
        apart = (ahead("us") > F.col("us")) & (F.coalesce(last("us"), F.lit(-1)) < F.col("us")) & (ahead("price") != F.col("price"))
        return events.where("in_win IS NOT NULL").withColumn("_ok", apart & F.col("in_win") & ahead("in_win") & (F.floor(ahead("us") / DAY_US) == F.floor(F.col("us") / DAY_US))).where("_ok").drop("_ok")
    return events.where({"px": "in_win AND has_px AND lvl_off >= 0 AND lvl_off < 10", "size": "msg_type = 'D'", "dt": "in_win"}[kind])


def mutated(events: DataFrame, kind: str, seed: int = 1) -> DataFrame:
    """``events`` with one change in each instrument that has an eligible event, and ``at``: its place there.

    The event is the eligible one whose place has the smallest hash with the seed.
    """
    drawn = F.min_by("place", F.md5(F.concat_ws(":", F.lit(seed), "locate", "place")))
    out = events.join(eligible(events, kind).groupBy("locate").agg(drawn.alias("at")), "locate")
    here = F.col("place") == F.col("at")
    if kind == "swap":
        return out.withColumn("place", F.when(here, F.col("place") + 1).when(F.col("place") == F.col("at") + 1, F.col("at")).otherwise(F.col("place")))
    field = {"px": "lvl_off", "size": "size", "dt": "dt"}[kind]
    return out.withColumn(field, F.col(field) + here.cast("long"))


def detection(events: DataFrame, seed: int = 1) -> DataFrame:
    """(kind, locate, at, first, n): for the stream as it is (none) and with each change, where it was changed, the first place
    at which a strict replay objects, and how many places it objects to."""
    out = None
    for kind in ["none", *MUTATIONS]:
        stream = events.withColumn("at", F.lit(None).cast("bigint")) if kind == "none" else mutated(events, kind, seed)
        row = mismatches(stream).groupBy("locate").agg(F.max("at").alias("at"), F.min(F.when(F.col("any"), F.col("place"))).alias("first"), F.count_if(F.col("any")).alias("n"))
        row = row.select(F.lit(kind).alias("kind"), "locate", "at", "first", "n")
        out = row if out is None else out.unionByName(row)
    return out


def reject_contexts(replayed: DataFrame, n: int, around: int) -> DataFrame:
    """(locate, seq, nth, result, msg_type, order_ref, side, price, bid, ask, open_orders, before, after): the first n rejected
    messages of each book, with the result of up to ``around`` messages before and after each.

    One frame-bounded window gathers the neighbours, so nothing but 2 * around + 1 rows is ever held; the first n are kept by a
    top n that Spark prunes within each task before the shuffle. side and price are the referenced order's, if it rests.
    """
    w = Window.partitionBy("locate").orderBy("us", "seq")
    text = F.concat_ws(":", "seq", "msg_type", "result")
    near = replayed.withColumns({"before": F.collect_list(text).over(w.rowsBetween(-around, -1)), "after": F.collect_list(text).over(w.rowsBetween(1, around))})
    rejects = near.where("result <> 'Ok'").withColumn("nth", F.row_number().over(w).cast("long")).where(F.col("nth") <= n)
    names = ("locate", "seq", "nth", "result", "msg_type", "order_ref", "side", "price", "bid", "ask", "open_orders")
    return rejects.select(*names, F.array_join("before", " ").alias("before"), F.array_join("after", " ").alias("after"))
