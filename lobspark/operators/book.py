"""Order books as relations, for feeds without rejects: lifecycles, level states, touch, depth, ledger.

A message is (locate, seq, us, msg_type, order_ref, side, shares, price): A and F add an order, E, C and X take shares
from it, D removes it (U comes as D and A, see ``fold.expand_replaces``). Side and price of a reduction come from its
order. Reject-free is what ``fold`` checks; here it is taken as given. Everything partitions by locate or finer, by order or by price level.

What is asked of all live levels at once is never a product of times and levels. A level that is live from one message to
another is put under a few nodes of a tree over the messages' numbers, 16 to a node, and a message looks only at the nodes above
it, which is a join on equal keys (``spans``, ``paths``). How many levels are better than a price is counted in the
same way over the ranks of prices (``places``). Rows grow as the messages times the tree's depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lobspark.operators.series import backward_asof, by
from lobspark.sources.tables import checkpointed

ADDS, TAKES = ["A", "F"], ["E", "C", "X", "D"]


def derived_feed(events: DataFrame) -> DataFrame:
    """Valid order messages from (event_id, us, user_id, event_type, value), the n-th reduction of an instrument going
    to its n-th order if that is earlier. seq is the event's id."""
    e = events.select((F.col("user_id") % 8 + 1).alias("locate"), F.col("event_id").alias("seq"), "us", "event_type", F.floor(F.col("value") * 100 + 0.5).alias("cents"))
    kind = F.when(F.col("event_type").isin("signup", "click", "view"), "add").otherwise("take")
    e = e.withColumn("kind", kind).withColumn("k", F.row_number().over(by("locate", "kind").orderBy("us", "seq")))
    even = F.col("seq") % 2 == 0
    step = 100 * (1 + F.col("cents") % 20)
    # the k-th order and the k-th reduction meet in one window: no self-join
    pair, adding = by("locate", "k"), F.col("kind") == "add"
    of = lambda c: F.max(F.when(adding, c)).over(pair)
    shares = 100 * (1 + F.col("seq") % 10)
    e = e.withColumns({"order_ref": of(F.col("seq")), "add_us": of(F.col("us")), "added": of(shares)})
    e = e.where(adding | (F.col("add_us") < F.col("us")) | ((F.col("add_us") == F.col("us")) & (F.col("order_ref") < F.col("seq"))))
    buy = F.col("event_type") == "purchase"
    whole = (buy & even) | (~buy & (F.col("seq") % 3 != 0))
    taking = F.when(buy, "E").when(F.col("seq") % 3 == 0, "X").otherwise("D")
    return e.select(
        "locate",
        "seq",
        "us",
        F.when(adding, F.when(F.col("event_type") == "view", "F").otherwise("A")).otherwise(taking).alias("msg_type"),
        "order_ref",
        F.when(adding, F.when(even, "B").otherwise("S")).alias("side"),
        F.when(adding, shares).when(whole, F.col("added")).otherwise(F.floor(F.col("added") / 2)).alias("shares"),
        F.when(adding, F.when(even, 1_000_000 - step).otherwise(1_000_000 + step)).alias("price"),
    )


#: Messages right after an order (ref, with side, shares, price) that a book must refuse, or that undo each other:
#: by the order's seq modulo 8, and then type, reference, new reference, side, shares, price, and the result.
#: own1 and own2 are references of their own; far is a price that only an opposite order of their own reaches.
NOISE = [
    (0, "A", "ref", None, "side", "100", "price", "DuplicateId"),
    (1, "E", "own1", None, None, "100", None, "UnknownId"),
    (1, "X", "own1", None, None, "100", None, "UnknownId"),
    (1, "D", "own1", None, None, None, None, "UnknownId"),
    (1, "U", "own1", "own2", None, "100", "price", "UnknownId"),
    (2, "A", "own1", None, "side", "0", "price", "ZeroShares"),
    (2, "E", "ref", None, None, "0", None, "ZeroShares"),
    (3, "C", "ref", None, None, "shares + 1", None, "TooManyShares"),
    (3, "X", "ref", None, None, "shares + 1", None, "TooManyShares"),
    (4, "F", "own1", None, "other", "100", "price", "WouldCross"),
    (5, "U", "ref", "ref", None, "100", "price", "BadReplace"),
    (5, "U", "ref", "own1", None, "0", "price", "ZeroShares"),
    (6, "A", "own1", None, "side", "100", "price", "Ok"),
    (6, "U", "own1", "own2", None, "50", "price", "Ok"),
    (6, "U", "own2", "ref", None, "50", "price", "DuplicateId"),
    (6, "D", "own2", None, None, None, None, "Ok"),
    (7, "A", "own1", None, "other", "100", "far", "Ok"),
    (7, "U", "ref", "own2", None, "100", "far", "WouldCross"),
    (7, "D", "own1", None, None, None, None, "Ok"),
]


def noisy_feed(messages: DataFrame) -> DataFrame:
    """A feed without rejects, with every second E as a C, and with NOISE after its orders. seq is 32 times what it was,
    plus a number for what was put in; new_ref is added."""
    null = F.lit(None).cast("bigint")
    kind = F.when((F.col("seq") % 2 == 0) & (F.col("msg_type") == "E"), "C").otherwise(F.col("msg_type"))
    plain = F.struct(F.lit(0).alias("i"), kind.alias("msg_type"), "order_ref", null.alias("new_ref"), "side", F.col("shares").cast("bigint").alias("shares"), F.col("price").cast("bigint").alias("price"))
    buy = F.col("side") == "B"
    named = {"ref": F.col("order_ref"), "own1": F.col("order_ref") + 10**12, "own2": F.col("order_ref") + 2 * 10**12, "side": F.col("side"), "other": F.when(buy, "S").otherwise("B"), "price": F.col("price"), "far": F.when(buy, 2_000_000).otherwise(100)}
    of = lambda what, kind: F.lit(None).cast(kind) if what is None else (named[what] if what in named else F.expr(what)).cast(kind)
    each = [
        F.when(F.col("msg_type").isin(ADDS) & (F.col("seq") % 8 == k), F.struct(F.lit(i + 1).alias("i"), F.lit(t).alias("msg_type"), of(ref, "bigint").alias("order_ref"), of(new, "bigint").alias("new_ref"), of(side, "string").alias("side"), of(n, "bigint").alias("shares"), of(price, "bigint").alias("price")))
        for i, (k, t, ref, new, side, n, price, _) in enumerate(NOISE)
    ]
    # one explode: what makes the messages is computed once
    rows = messages.select("locate", "seq", "us", F.explode(F.array_compact(F.array(plain, *each))).alias("n"))
    return rows.select("locate", (F.col("seq") * 32 + F.col("n.i")).alias("seq"), "us", "n.msg_type", "n.order_ref", "n.new_ref", "n.side", "n.shares", "n.price")


#: Chains of replaces for each side of an instrument in ``chained_feed``.
CHAINS = 5


def chained_feed(messages: DataFrame) -> DataFrame:
    """A feed of adds and replaces alone: each side's orders are dealt to CHAINS chains, of which the first order is added and
    each further one replaces the one before."""
    adds = messages.where(F.col("msg_type").isin(ADDS))
    adds = adds.withColumn("chain", (F.row_number().over(by("locate", "side").orderBy("us", "seq")) - 1) % CHAINS)
    old = F.lag("order_ref").over(by("locate", "side", "chain").orderBy("us", "seq"))
    adds = adds.withColumn("old", old)
    first = F.col("old").isNull()
    return adds.select("locate", "seq", "us", F.when(first, "A").otherwise("U").alias("msg_type"), F.coalesce("old", "order_ref").alias("order_ref"), F.when(~first, F.col("order_ref")).alias("new_ref"), F.when(first, F.col("side")).alias("side"), "shares", "price")


def lifecycle(messages: DataFrame, *more: str) -> DataFrame:
    """Messages with their order's side and price, and the shares it has before and after. more: columns to keep.

    The shares of a D are what its order has left, whatever the message says. A reference may be used again after its
    order has ended: side, price and shares are those of its last add. ``d`` is the change of the order's shares.
    """
    w = by("locate", "order_ref").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    adding = F.col("msg_type").isin(ADDS)
    own = lambda c: F.last(F.when(adding, F.col(c)), ignorenulls=True).over(w).alias(c)
    said = F.when(adding, F.col("shares")).when(F.col("msg_type") == "D", 0).otherwise(-F.col("shares"))
    out = messages.select("locate", "seq", "us", "msg_type", "order_ref", own("side"), own("price"), "shares", said.alias("said"), F.sum(said).over(w).alias("run"), *more)
    base = F.last(F.when(adding, F.col("run") - F.col("said")), ignorenulls=True).over(w)
    out = out.withColumn("before", F.col("run") - F.col("said") - base)
    out = out.withColumn("d", F.when(F.col("msg_type") == "D", -F.col("before")).otherwise(F.col("said")))
    return out.withColumn("after", F.col("before") + F.col("d")).drop("said", "run")


def deltas(messages: DataFrame) -> DataFrame:
    """(locate, seq, us, side, price, d, orders): each message's change of its price level."""
    life = lifecycle(messages)
    orders = F.when(F.col("msg_type").isin(ADDS), 1).when(F.col("after") == 0, -1).otherwise(0).cast("long")
    return life.select("locate", "seq", "us", "side", "price", "d", orders.alias("orders"))


def level_states(messages: DataFrame) -> DataFrame:
    """Shares and orders of a price level after each message that touches it."""
    w = by("locate", "side", "price").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return deltas(messages).select("locate", "side", "price", "seq", "us", F.sum("d").over(w).alias("shares"), F.sum("orders").over(w).alias("orders"))


def snapshot(messages: DataFrame, at: int | None = None) -> DataFrame:
    """The book just before ``at`` (or at the end): resting orders with their rank in the book, best price first, then
    arrival."""
    life = lifecycle(messages if at is None else messages.where(F.col("us") < at))
    order = F.struct("us", "seq")
    arrival = F.max(F.when(F.col("msg_type").isin(ADDS), F.col("seq")))
    last = life.groupBy("locate", "order_ref").agg(F.max_by("side", order).alias("side"), F.max_by("price", order).alias("price"), F.sum("d").alias("shares"), arrival.alias("arrival")).where("shares > 0")
    best_first = F.when(F.col("side") == "B", -F.col("price")).otherwise(F.col("price"))
    rank = F.row_number().over(by("locate", "side").orderBy(best_first, "arrival")).cast("long")
    return last.select("locate", "side", rank.alias("ord"), "price", "order_ref", "shares")


#: A tree over the numbers of an instrument's messages: 16 children to a node.
BITS = 4
#: From this level on, a million messages, a node is above more than a partition's worth, and these are dealt to SALTS groups.
UPPER, SALTS = 5, 16
#: Digits of price ranks: base 4, so many at most.
RANK_BITS, RANK_DIGITS = 2, 16


def numbered(messages: DataFrame) -> DataFrame:
    """With ``pos``: the message's number in its instrument, from 1."""
    return messages.withColumn("pos", F.row_number().over(by("locate").orderBy("us", "seq")).cast("long"))


def level_rows(messages: DataFrame) -> DataFrame:
    """Numbered messages with their level's state: (locate, seq, us, pos, msg_type, order_ref, side, price, moved, had,
    shares, orders, one, edge).

    moved: shares that the message adds or takes; had, shares: the level's before and after; orders: the level's after;
    one: by how many its orders change; edge: 1 where the level comes into being, -1 where it ends, else 0.
    """
    life = lifecycle(numbered(messages), "pos")
    one = F.when(F.col("msg_type").isin(ADDS), 1).when(F.col("after") == 0, -1).otherwise(0).cast("long")
    life = life.select("locate", "seq", "us", "pos", "msg_type", "order_ref", "side", "price", F.abs("d").alias("moved"), "d", one.alias("one"))
    w = by("locate", "side", "price").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = life.withColumns({"shares": F.sum("d").over(w), "orders": F.sum("one").over(w)}).withColumn("had", F.col("shares") - F.col("d"))
    edge = F.when((F.col("had") <= 0) & (F.col("shares") > 0), 1).when((F.col("had") > 0) & (F.col("shares") <= 0), -1).otherwise(0).cast("long")
    return out.withColumn("edge", edge).drop("d")


def depth_of(rows: DataFrame) -> int:
    """How many levels of nodes the tree needs for these rows' numbers (pos)."""
    most, depth = rows.agg(F.max("pos")).first()[0] or 0, 1
    while most >= endless(depth):
        depth += 1
    return depth


def endless(depth: int) -> int:
    """Beyond all numbers of a tree so deep: where what is live at the end ends."""
    return 1 << BITS * depth


def spans(a: str, b: str, depth: int) -> Column:
    """The nodes (l, node, salt) that together are above the numbers from a to b - 1 and no others.

    At most 30 a level; up to the end of all numbers at most 15 a level, so 60 for a million messages. A node of an upper
    level comes once for each salt.
    """
    size = lambda l: f"shiftleft(1L, {BITS} * ({l}))"
    first = lambda l: f"shiftright({a} + {size(l)} - 1, {BITS} * ({l}))"
    last = lambda l: f"(shiftright({b}, {BITS} * ({l})) - 1)"
    run = lambda x, y: f"if({x} <= {y}, sequence({x}, {y}), array())"
    covered = f"l < {depth - 1} AND {first('l + 1')} <= {last('l + 1')}"  # what nodes of the next level are above
    left = run(first("l"), f"if({covered}, {first('l + 1')} * {1 << BITS} - 1, {last('l')})")
    right = f"if({covered}, {run(f'({last("l + 1")} + 1) * {1 << BITS}', last('l'))}, array())"
    salts = f"if(l >= {UPPER}, sequence(0L, {SALTS - 1}L), array(0L))"
    node = f"transform({salts}, s -> named_struct('l', l, 'node', n, 'salt', s))"
    return F.expr(f"flatten(transform(sequence(0, {depth - 1}), l -> flatten(transform(concat({left}, {right}), n -> {node}))))")


def paths(pos: str, depth: int) -> Column:
    """The nodes (l, node, salt) above a number."""
    return F.expr(f"transform(sequence(0, {depth - 1}), l -> named_struct('l', l, 'node', shiftright({pos}, {BITS} * l), 'salt', if(l >= {UPPER}, {pos} % {SALTS}, 0L)))")


def best_changes(rows: DataFrame) -> DataFrame:
    """(locate, pos, side, best): the best price of a side after each message with which one of its levels comes or goes.

    rows: ``level_rows``. best is NULL where the side is empty.
    """
    depth = depth_of(rows)
    edges = rows.where("edge <> 0").select("locate", "side", "price", "pos", "edge")
    off = F.coalesce(F.lead("pos").over(by("locate", "side", "price").orderBy("pos")), F.lit(endless(depth)))
    edges = edges.withColumns({"off": off, "good": F.when(F.col("side") == "B", F.col("price")).otherwise(-F.col("price"))})
    live = edges.where("edge = 1").select("locate", "side", F.lit(None).cast("bigint").alias("pos"), "good", F.explode(spans("pos", "off", depth)).alias("n"))
    asked = edges.select("locate", "side", "pos", F.lit(None).cast("bigint").alias("good"), F.explode(paths("pos", depth)).alias("n"))
    each = live.unionByName(asked).select("locate", "side", "pos", "good", "n.*")
    # within a node the levels (without pos) come first
    best = F.max("good").over(by("locate", "side", "l", "node", "salt").orderBy(F.col("pos").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    found = each.withColumn("good", best).where("pos IS NOT NULL").groupBy("locate", "side", "pos").agg(F.max("good").alias("good"))
    return found.select("locate", "pos", "side", F.abs("good").alias("best"))


def places(rows: DataFrame) -> DataFrame:
    """(locate, pos, n_levels, better, same): of the message's side just before it, how many levels are live, how many of
    them better than its price, and how many at its price.

    rows: ``level_rows``. Prices are ranked from the best; two ranks differ first in one base-4 digit, so the better
    levels are those with a smaller digit there: running sums by digit in each group of ranks that agree above it.
    """
    best_first = F.when(F.col("side") == "B", -F.col("price")).otherwise(F.col("price"))
    ranks = rows.select("locate", "side", "price").distinct()
    ranks = ranks.withColumns({"r": F.row_number().over(by("locate", "side").orderBy(best_first)) - 1, "top": F.count("*").over(by("locate", "side")) - 1})
    ranked = rows.select("locate", "side", "price", "pos", "edge", "had").join(ranks, ["locate", "side", "price"])
    digits = F.expr(f"array_min(filter(sequence(1, {RANK_DIGITS}), k -> shiftright(top, {RANK_BITS} * k) = 0))")
    each = ranked.select("locate", "side", "pos", "edge", (F.col("had") > 0).cast("long").alias("same"), F.posexplode(F.array_repeat(F.col("r").cast("long"), digits)).alias("l", "r"))
    digit = F.expr(f"shiftright(r, {RANK_BITS} * l) & {(1 << RANK_BITS) - 1}")
    each = each.select("locate", "side", "pos", "edge", "same", "l", F.expr(f"shiftright(r, {RANK_BITS} * (l + 1))").alias("group"), digit.alias("digit")).where("l = 0 OR edge <> 0 OR digit > 0")
    w = by("locate", "side", "l", "group").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    less = {f"s{j}": F.sum(F.when(F.col("digit") == j, F.col("edge"))).over(w) for j in range((1 << RANK_BITS) - 1)}
    count = sum((F.when(F.col("digit") > j, F.coalesce(f"s{j}", F.lit(0))).otherwise(0) for j in range(len(less))), F.lit(0))
    better = each.withColumns(less).groupBy("locate", "side", "pos").agg(F.sum(count).alias("better"), F.max("same").alias("same"), F.sum(F.when(F.col("l") == 0, F.col("edge"))).alias("edge"))
    before = F.coalesce(F.sum("edge").over(by("locate", "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return better.select("locate", "pos", before.alias("n_levels"), "better", "same")


def touched(rows: DataFrame) -> DataFrame:
    """(locate, seq, us, pos, msg_type, order_ref, side, price, moved, bid, ask, open_orders, levels): the best prices
    after each message, and how many orders and levels the book has. rows: ``level_rows``."""
    names = ("locate", "seq", "us", "pos", "msg_type", "order_ref", "side", "price", "moved", "one", "edge")
    of = lambda side: F.when(F.col("c_side") == side, F.struct("best"))
    changes = best_changes(rows).withColumnRenamed("side", "c_side")
    both = rows.select(*names).unionByName(changes, allowMissingColumns=True)
    w = by("locate").orderBy("pos", F.col("c_side").isNull()).rowsBetween(Window.unboundedPreceding, 0)  # a change before its message
    out = both.select(
        *names[:9],
        F.last(of("B"), ignorenulls=True).over(w)["best"].alias("bid"),
        F.last(of("S"), ignorenulls=True).over(w)["best"].alias("ask"),
        F.sum("one").over(w).alias("open_orders"),
        F.sum("edge").over(w).alias("levels"),
    )
    return out.where("seq IS NOT NULL")


def with_depth(touch: DataFrame, rows: DataFrame) -> DataFrame:
    """``touched`` with bid_shares and ask_shares: what the best levels hold, by one merge with their states."""
    own = [c for c in touch.columns if c not in ("locate", "pos")]
    carried = F.struct(*own)
    sides = F.array(F.struct(F.lit("B").alias("side"), F.col("bid").alias("price"), carried.alias("own")), F.struct(F.lit("S").alias("side"), F.col("ask").alias("price"), F.lit(None).alias("own")))
    asked = touch.select("locate", "pos", F.explode(sides).alias("s")).select("locate", "s.side", "s.price", "pos", "s.own")
    states = rows.select("locate", "side", "price", "pos", "shares")
    both = states.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    w = by("locate", "side", "price").orderBy("pos", "kind")
    found = both.withColumn("shares", F.last("shares", ignorenulls=True).over(w)).where("kind = 1")
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("shares")))
    out = found.groupBy("locate", "pos").agg(F.first("own", ignorenulls=True).alias("own"), of("B").alias("bid_shares"), of("S").alias("ask_shares"))
    return out.select("locate", "pos", "own.*", "bid_shares", "ask_shares")


def replay(messages: DataFrame, depth: bool = True, ranks: bool = True) -> DataFrame:
    """A row for each message of a feed without rejects, as ``fold.replay`` gives them, from relations alone.

    Columns: ``touched``, with shares for moved; with ``depth`` bid_shares and ask_shares; with ``ranks`` has_px (whether
    the side had levels) and lvl_off (how many of them were better, -1 if the price was better than all).
    """
    rows = checkpointed(level_rows(messages))  # read three to five times below
    out = touched(rows)
    if depth:
        out = with_depth(out, rows)
    if ranks:
        off = F.when(F.col("n_levels") == 0, 0).when((F.col("better") == 0) & (F.col("same") == 0), -1).otherwise(F.col("better"))
        out = out.join(places(rows).select("locate", "pos", (F.col("n_levels") > 0).alias("has_px"), off.cast("long").alias("lvl_off")), ["locate", "pos"])
    return out.withColumnRenamed("moved", "shares").withColumn("result", F.lit("Ok"))


def touch_at(messages: DataFrame, step: int) -> DataFrame:
    """Best prices and depth there, strictly before each multiple of ``step`` from an instrument's first message to its
    last: the touch after the last message before it, by one merge.

    (locate, t, bid, bid_shares, ask, ask_shares); an empty side is NULL.
    """
    ends = messages.groupBy("locate").agg(F.ceil(F.min("us") / step).alias("a"), F.floor(F.max("us") / step).alias("b")).where("a <= b")
    grid = ends.select("locate", F.explode(F.transform(F.sequence("a", "b"), lambda k: k * step)).alias("t"))
    touch = F.struct("bid", "bid_shares", "ask", "ask_shares")
    after = replay(messages, ranks=False).select("locate", F.col("us").alias("t"), F.col("pos").alias("order"), touch.alias("touch"))
    return backward_asof(grid, after, "locate", ["touch"], strict=True).select("locate", "t", "touch.*")


def top_levels(messages: DataFrame, n: int) -> DataFrame:
    """The best ``n`` levels of each side at the end: (locate, side, level, price, shares, orders)."""
    d = deltas(messages).groupBy("locate", "side", "price").agg(F.sum("d").alias("shares"), F.sum("orders").alias("orders")).where("shares > 0")
    best_first = F.when(F.col("side") == "B", -F.col("price")).otherwise(F.col("price"))
    return d.withColumn("level", F.row_number().over(by("locate", "side").orderBy(best_first)).cast("long")).where(F.col("level") <= n).select("locate", "side", "level", "price", "shares", "orders")


def ledger(messages: DataFrame) -> DataFrame:
    """Added, executed, canceled, resting shares by instrument; added is the sum of the others."""
    of = lambda *types: F.coalesce(F.sum(F.when(F.col("msg_type").isin(*types), F.col("shares"))), F.lit(0)).cast("long")
    out = messages.groupBy("locate").agg(of("A", "F").alias("added"), of("E", "C").alias("executed"), of("X", "D").alias("canceled"))
    return out.withColumn("resting", F.col("added") - F.col("executed") - F.col("canceled"))


def sweep(levels: DataFrame, want: DataFrame) -> DataFrame:
    """One marketable order against resting orders: fills best price first, then by arrival.

    levels: (locate, price, order_ref, shares, ord); want: (locate, limit, want), a buy against asks. Each resting order
    gives what is still wanted after the shares ahead of it: a running sum instead of a walk. A fill has the resting
    order's price.
    """
    eligible = levels.join(want, "locate").where("price <= limit")
    ahead = F.coalesce(F.sum("shares").over(by("locate").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return eligible.withColumn("fill", F.greatest(F.lit(0), F.least(F.col("shares"), F.col("want") - ahead))).where("fill > 0").select("locate", "order_ref", "price", F.col("fill").alias("shares"))
