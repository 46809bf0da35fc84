"""Column functions of the order-message model: clocks, prices, buckets, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TICK = 100  # of fixed-point prices with four implied decimals: one cent
OPEN_NS, CLOSE_NS = 34_200_000_000_000, 57_600_000_000_000  # 09:30 and 16:00 since midnight
SESSION_S = (CLOSE_NS - OPEN_NS) // 1_000_000_000
DAY_US = 86_400_000_000

#: Body lengths by message type (fixed values of the wire format).
BODY_LENGTH = {"A": 36, "F": 40, "E": 31, "C": 36, "X": 23, "D": 19, "U": 35}
BOOK_TYPES = list(BODY_LENGTH)


def body_length(msg_type: Column) -> Column:
    out = F.lit(None).cast("long")
    for t, n in BODY_LENGTH.items():
        out = F.when(msg_type == t, F.lit(n).cast("long")).otherwise(out)
    return out


def rendered() -> Column:
    """An order message as a line: A and F with side, shares and price; C with its price where it has one; D with its
    reference alone; E and X with shares. See ``rendered_replace`` for U."""
    price = F.when(F.col("price").isNotNull(), F.format_string("@ %.4f", dollars(F.col("price"))))
    t, ref = F.col("msg_type"), F.col("order_ref")
    plain = F.concat_ws(" ", t, ref, "shares")
    line = F.when(t.isin("A", "F"), F.concat_ws(" ", t, ref, "side", "shares", price)).when(t == "D", F.concat_ws(" ", t, ref)).when(t == "C", F.concat_ws(" ", t, ref, "shares", price))
    return line.otherwise(plain)


def rendered_replace(new_ref: Column) -> Column:
    """The line of a U."""
    return F.concat_ws(" ", F.lit("U"), "order_ref", F.lit("->"), new_ref, "shares", F.format_string("@ %.4f", dollars(F.col("price"))))


def is_book_type(msg_type: Column) -> Column:
    return msg_type.isin(BOOK_TYPES)


def in_session(ts_ns: Column) -> Column:
    """Half-open: 09:30 <= ts < 16:00."""
    return (ts_ns >= OPEN_NS) & (ts_ns < CLOSE_NS)


def in_session_us(us: Column) -> Column:
    """The same for microseconds of the epoch."""
    return in_session(us % DAY_US * 1000)


def clock(ts_ns: Column) -> Column:
    """HH:MM:SS of nanoseconds since midnight."""
    s = F.floor(ts_ns / 1_000_000_000)
    part = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    return F.concat_ws(":", part(F.floor(s / 3600)), part(F.floor(s / 60) % 60), part(s % 60))


def dollars(price: Column) -> Column:
    return price / 10000.0


def spread_ticks(bid: Column, ask: Column, tick: int = TICK) -> Column:
    """Rounded to whole ticks by integer arithmetic."""
    return F.floor((ask - bid + tick // 2) / tick)


def distance_ticks(price: Column, opposite: Column, tick: int = TICK, most: int = 101) -> Column:
    """From the opposite best, in [1, most]; NULL where that side is empty and there is nothing to measure from."""
    d = F.floor((F.abs(price - opposite) + tick // 2) / tick)
    return F.when(opposite != 0, F.greatest(F.lit(1), F.least(F.lit(most), d))).cast("long")


def bucket(x: Column, edges: Column) -> Column:
    """How many edges are at most x."""
    return F.size(F.filter(edges, lambda e: e <= x)).cast("long")


def representative(b: Column, edges: Column) -> Column:
    """The value that stands for a bucket: one below the first edge, else the edge it begins with."""
    return F.when(b == 0, F.element_at(edges, 1) - 1).otherwise(F.element_at(edges, F.greatest(b, F.lit(1)).cast("int")))


def valid_edges(edges: Column) -> Column:
    """Two or more, strictly rising."""
    pairs = F.arrays_zip(F.slice(edges, F.lit(1), F.size(edges) - 1).alias("a"), F.slice(edges, F.lit(2), F.size(edges) - 1).alias("b"))
    return (F.size(edges) >= 2) & F.when(F.size(edges) >= 2, F.forall(pairs, lambda p: p["a"] < p["b"])).otherwise(False)


def bumped_edges(edges: Column) -> Column:
    """The least strictly rising edges, from 2 on, that are nowhere below the given ones."""
    nothing = F.array().cast("array<bigint>")
    return F.aggregate(edges, nothing, lambda acc, e: F.concat(acc, F.array(F.greatest(e, F.when(F.size(acc) == 0, F.lit(2).cast("long")).otherwise(F.element_at(acc, -1) + 1)))))


def half_decade(gap_ns: Column) -> Column:
    """Logarithmic bucket of a gap: two a decade, in [0, 25]."""
    return F.when(gap_ns > 0, F.greatest(F.lit(0), F.least(F.lit(25), F.floor(F.log10(gap_ns.cast("double")) * 2)))).cast("long")


#: First ids of the token groups (fixed values): type, side, price offset from -1, its tail, size, gap zero, gaps.
TYPE0, SIDE0, PX0, PX_TAIL, SIZE0, DT_ZERO, DT0, UNK = 7, 13, 15, 27, 28, 36, 37, 0
ETYPES = ["Add", "PartialCancel", "Delete", "ExecVisible", "ExecHidden", "CrossTrade"]
#: The special ids (fixed values).
BOS, EOS, SESSION_OPEN, SESSION_CLOSE, HALT, RESUME = 1, 2, 3, 4, 5, 6


def type_token(etype: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, ETYPES)), etype) + TYPE0 - 1).cast("long")


def side_token(side: Column) -> Column:
    return F.when(side == "B", SIDE0).otherwise(SIDE0 + 1).cast("long")


def px_token(has_px: Column, lvl_off: Column) -> Column:
    """Offsets -1 to 10 have a token each; lower ones count as -1, deeper ones share the tail."""
    return F.when(~has_px, UNK).when(lvl_off < -1, PX0).when(lvl_off > 10, PX_TAIL).otherwise(lvl_off + PX0 + 1).cast("long")


def size_token(size: Column, edges: Column) -> Column:
    return bucket(size, edges) + SIZE0


def dt_token(dt: Column, edges: Column) -> Column:
    return F.when(dt <= 0, F.lit(DT_ZERO).cast("long")).otherwise(bucket(dt, edges) + DT0)


#: Names of the tokens before the numbered groups (fixed values).
NAMES = ["UNK", "BOS", "EOS", "SESSION_OPEN", "SESSION_CLOSE", "HALT", "RESUME", "TYPE_ADD", "TYPE_CANCEL", "TYPE_DELETE", "TYPE_EXEC", "TYPE_EXEC_HIDDEN", "TYPE_CROSS", "SIDE_BID", "SIDE_ASK"]
VOCABULARY = 52


def token_name(token: Column) -> Column:
    """The vocabulary's name of an id, ``?`` outside of it."""
    number = lambda prefix, first: F.concat(F.lit(prefix), (token - first).cast("string"))
    offset = token - PX0 - 1
    return (
        F.when((token < 0) | (token >= VOCABULARY) | token.isNull(), "?")
        .when(token < PX0, F.element_at(F.array(*map(F.lit, NAMES)), (F.greatest(token, F.lit(0)) + 1).cast("int")))
        .when(token < PX_TAIL, F.concat(F.lit("PX"), F.when(offset < 0, "").otherwise("+"), offset.cast("string")))
        .when(token == PX_TAIL, "PX_TAIL")
        .when(token < DT_ZERO, number("SZ", SIZE0))
        .when(token == DT_ZERO, "DT_ZERO")
        .when(token == VOCABULARY - 1, "DT_TAIL")
        .otherwise(number("DT", DT0))
    )
