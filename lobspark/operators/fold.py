"""The book with all reject rules, as keyed state over an instrument's messages in order.

Whether a message is rejected depends on every one before it, so this part is a fold: Spark groups by instrument
and sorts, and a small function steps through a group's Arrow batches as they come, without holding the group. Each
message gets a row with its result and the book after it; all that follows from these rows is relational.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import namedtuple
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Message = namedtuple("Message", "locate seq us msg_type order_ref new_ref side shares price")

#: Columns that the fold adds, all of them after the message: result, touch with depth, counts, and where an added or
#: reduced order stood (levels better than its price on its side, before an add, or before the reduction).
SCHEMA = """locate long, seq long, us long, msg_type string, order_ref long, result string, side string, price long, shares long,
bid long, bid_shares long, ask long, ask_shares long, open_orders long, levels long, lvl_off long, has_px boolean, fifo_head boolean"""


class Book:
    """Orders by reference, price levels by side. A level keeps its orders in arrival order (a dict does)."""

    def __init__(self):
        self.orders: dict[int, list] = {}  # ref -> [side, price, shares]
        self.levels: dict[str, dict[int, dict[int, None]]] = {"B": {}, "S": {}}
        self.prices: dict[str, list[int]] = {"B": [], "S": []}
        self.depth: dict[tuple[str, int], int] = {}
        self.ledger = {"added": 0, "executed": 0, "canceled": 0}

    def best(self, side: str) -> int | None:
        p = self.prices[side]
        return (p[-1] if side == "B" else p[0]) if p else None

    def better(self, side: str, price: int) -> tuple[bool, int]:
        """Whether the side has levels, and how many are better than the price; -1 if the price is better than all."""
        p = self.prices[side]
        if not p:
            return False, 0
        at = bisect_left(p, price)
        n = len(p) - bisect_left(p, price + 1) if side == "B" else at
        return True, -1 if n == 0 and price not in self.levels[side] else n

    def crosses(self, side: str, price: int) -> bool:
        """Whether an order at the price would meet the opposite best."""
        other = self.best("S" if side == "B" else "B")
        return other is not None and (price >= other if side == "B" else price <= other)

    def add(self, ref: int, side: str, shares: int, price: int) -> str:
        if shares <= 0:
            return "ZeroShares"
        if ref in self.orders:
            return "DuplicateId"
        if self.crosses(side, price):
            return "WouldCross"
        self.rest(ref, side, shares, price)
        self.ledger["added"] += shares
        return "Ok"

    def rest(self, ref: int, side: str, shares: int, price: int) -> None:
        """Puts an order at the back of its queue that is known to rest there."""
        self.orders[ref] = [side, price, shares]
        if price not in self.levels[side]:
            self.levels[side][price] = {}
            insort(self.prices[side], price)
        self.levels[side][price][ref] = None
        self.depth[side, price] = self.depth.get((side, price), 0) + shares

    def reduce(self, ref: int, shares: int | None, to: str) -> str:
        """Takes shares (None: all) from an order, which keeps its place; at zero it goes, and an empty level with it."""
        if ref not in self.orders:
            return "UnknownId"
        side, price, have = self.orders[ref]
        shares = have if shares is None else shares
        if shares <= 0:
            return "ZeroShares"
        if shares > have:
            return "TooManyShares"
        self.ledger[to] += shares
        self.depth[side, price] -= shares
        self.orders[ref][2] -= shares
        if shares == have:
            del self.orders[ref], self.levels[side][price][ref]
            if not self.levels[side][price]:
                del self.levels[side][price], self.depth[side, price]
                self.prices[side].pop(bisect_left(self.prices[side], price))
        return "Ok"

    def replace(self, ref: int, new: int, shares: int, price: int) -> str:
        """Cancels the rest of an order and adds another at the back of its queue; nothing changes on a reject."""
        if ref == new:
            return "BadReplace"
        if ref not in self.orders:
            return "UnknownId"
        side = self.orders[ref][0]
        if new in self.orders:
            return "DuplicateId"
        if shares <= 0:
            return "ZeroShares"
        if self.crosses(side, price):
            return "WouldCross"
        self.reduce(ref, None, "canceled")
        return self.add(new, side, shares, price)

    def apply(self, t: str, ref: int, new: int, side: str, shares: int, price: int) -> str:
        if t in ("A", "F"):
            return self.add(ref, side, shares, price)
        if t in ("E", "C"):
            return self.reduce(ref, shares, "executed")
        if t == "X":
            return self.reduce(ref, shares, "canceled")
        if t == "D":
            return self.reduce(ref, None, "canceled")
        return self.replace(ref, new, shares, price) if t == "U" else "UnknownType"


def step(book: Book, m) -> tuple:
    """One message's row."""
    t, ref = m.msg_type, m.order_ref
    at = (m.side, m.price, m.shares) if t in ("A", "F") else tuple(book.orders.get(ref, (None, None, None)))
    has, off = book.better(at[0], at[1]) if at[0] in ("B", "S") else (False, 0)
    held = book.orders.get(ref)
    head = held is not None and next(iter(book.levels[held[0]][held[1]])) == ref
    moved = at[2] if t == "D" else m.shares
    result = book.apply(t, ref, m.new_ref, m.side, m.shares, m.price)
    bid, ask = book.best("B"), book.best("S")
    depth = lambda s, p: None if p is None else book.depth[s, p]
    return (m.locate, m.seq, m.us, t, ref, result, at[0], at[1], moved, bid, depth("B", bid), ask, depth("S", ask), len(book.orders), len(book.depth), off, has, head)


def replay(messages: DataFrame) -> DataFrame:
    """A row of ``SCHEMA`` for each message (locate, seq, us, msg_type, order_ref, new_ref, side, shares, price).

    Instruments are dealt out by locate and come sorted by (locate, us, seq), so that a task holds one book at a
    time and reads its messages batch by batch. Messages with a NULL locate are dropped with their instrument's
    group: they have no book.
    """
    dealt = messages.where("locate IS NOT NULL").select(*Message._fields).repartition(F.xxhash64("locate")).sortWithinPartitions("locate", "us", "seq")
    names = [f.split() for f in SCHEMA.replace("\n", " ").split(",")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[t] for _, t in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, book = None, Book()
        for batch in batches:
            rows = []
            for m in map(Message, *(c.to_pylist() for c in batch.columns)):
                if m.locate != now:
                    now, book = m.locate, Book()
                rows.append(step(book, m))
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [n for n, _ in names])

    return dealt.mapInArrow(run, SCHEMA)


def expand_replaces(messages: DataFrame) -> DataFrame:
    """Each U as the D of its order and the A of the new one (same time and side), numbered by pair_no; others have 0.

    For feeds without rejects. The new order's side is the replaced one's: pass messages whose U rows carry it.
    """
    pair = F.array(
        F.struct(F.lit("D").alias("t"), F.lit(1).alias("p"), F.col("order_ref").alias("r"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("px")),
        F.struct(F.lit("A").alias("t"), F.lit(2).alias("p"), F.col("new_ref").alias("r"), F.col("shares").alias("n"), F.col("price").alias("px")),
    )
    one = F.array(F.struct(F.col("msg_type").alias("t"), F.lit(0).alias("p"), F.col("order_ref").alias("r"), F.col("shares").alias("n"), F.col("price").alias("px")))
    each = messages.select("locate", "seq", "us", "side", F.explode(F.when(F.col("msg_type") == "U", pair).otherwise(one)).alias("e"))
    return each.select("locate", (F.col("seq") * 2 + F.when(F.col("e.p") == 2, 1).otherwise(0)).alias("seq"), "us", F.col("e.t").alias("msg_type"), F.col("e.r").alias("order_ref"), F.lit(None).cast("bigint").alias("new_ref"), "side", F.col("e.n").alias("shares"), F.col("e.px").alias("price"), F.col("e.p").cast("long").alias("pair_no"))
