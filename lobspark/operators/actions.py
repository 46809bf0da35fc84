"""Closed loops: streams of actions, or of event tokens, against a live book each.

What an action does depends on the book that the ones before it left, so a stream is folded like an instrument's
messages (see ``fold``): Spark deals the streams out and sorts them, and a small function steps through the rows. The
outcome rows carry rejects, fills and the order messages that the engine would journal, and everything else (counts,
reject tables, viability) is relational.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobspark.functions.scalars import DT0, DT_ZERO, PX0, PX_TAIL, RESUME, SIDE0, SIZE0, TICK, TYPE0, UNK
from lobspark.operators.fold import Book


@dataclass(frozen=True)
class Limits:
    """Bounds of plausible actions."""

    shares: int = 1_000_000
    price: int = 100_000_000
    relative: float = 0.5


OTHER = {"B": "S", "S": "B"}


def refused(book: Book, kind: str, side: str, price: int, shares: int, limits: Limits) -> str | None:
    """Why an action is rejected, by the first rule that it breaks; the size bound holds for cancels, too."""
    needs_price = kind in ("limit", "cancel")
    if side not in OTHER or (kind != "cancel" and not shares) or (needs_price and not price):
        return "Unparseable"
    if shares > limits.shares:
        return "EconomicallyAbsurd"
    if kind == "limit":
        touch = book.best(OTHER[side])
        if price > limits.price or (touch and abs(price / touch - 1) > limits.relative):
            return "EconomicallyAbsurd"
    if kind == "cancel" and price not in book.levels[side]:
        return "UnknownReference"
    return None


def matched(book: Book, side: str, shares: int, limit: int | None) -> list[tuple[int, int, int]]:
    """Fills (ref, shares, price) against the other side: best price first, oldest first, at the resting price."""
    fills = []
    while shares:
        best = book.best(OTHER[side])
        if best is None or (limit is not None and (best > limit if side == "B" else best < limit)):
            break
        ref = next(iter(book.levels[OTHER[side]][best]))
        n = min(shares, book.orders[ref][2])
        book.reduce(ref, n, "executed")
        fills.append((ref, n, best))
        shares -= n
    return fills


def submitted(book: Book, ref: int, kind: str, side: str, price: int, shares: int, limits: Limits) -> tuple[str | None, int, int, int, list[tuple]]:
    """(reject, filled, rested, canceled, journal). A cancel takes the oldest order at its price whole; a market order's
    rest vanishes; a limit order's rests. The journal holds (type, ref, side, shares, price) as they would be sent."""
    why = refused(book, kind, side, price, shares, limits)
    if why:
        return why, 0, 0, 0, []
    if kind == "cancel":
        head = next(iter(book.levels[side][price]))
        n = book.orders[head][2]
        book.reduce(head, None, "canceled")
        return None, 0, 0, n, [("D", head, side, n, price)]
    fills = matched(book, side, shares, price if kind == "limit" else None)
    journal = [("E", r, OTHER[side], n, p) for r, n, p in fills]
    filled = sum(n for _, n, _ in fills)
    rest = shares - filled if kind == "limit" else 0
    if rest:
        book.add(ref, side, rest, price)
        journal.append(("A", ref, side, rest, price))
    return None, filled, rest, 0, journal


def level_price(book: Book, side: str, k: int) -> int | None:
    """Price of the level with k better ones; None if there are fewer."""
    p = book.prices[side]
    return None if k >= len(p) else p[-1 - k] if side == "B" else p[k]


def resolved(book: Book, kind: int, side: str, offset: int | None, tick: int) -> tuple[int | None, str | None, bool]:
    """(price, why not, opened): where a token's level offset points in the live book; adds have kind TYPE0.

    No reference: one tick from the other side's best. Inside: one tick better than the side's best. A level that the
    book lacks: adds open one beyond the deepest, tail cancels take the deepest, other cancels have no target.
    """
    add, toward = kind == TYPE0, 1 if side == "B" else -1
    if offset is None:
        other = book.best(OTHER[side])
        return (None, "UnkNonAdd", False) if not add else (None, "UnkEmptyOpposite", False) if other is None else (other - toward * tick, None, False)
    if offset == -1:
        best = book.best(side)
        return (None, "InsideNonAdd", False) if not add else (None, "InsideNoBest", False) if best is None else (best + toward * tick, None, False)
    price = level_price(book, side, offset)
    if price is not None:
        return price, None, False
    tail = offset == PX_TAIL - PX0 - 1
    if not book.prices[side]:
        return None, "TailNoDepth" if tail else "LevelAbsent", False
    deepest = book.prices[side][0 if side == "B" else -1]
    if add:
        return deepest - toward * tick, None, True
    return (deepest, None, False) if tail else (None, "LevelAbsent", False)


def segments(tokens: list[int]) -> Iterator[tuple[int, list[int] | None]]:
    """(place, five tokens) of a stream; None for a token that starts no tuple and for a cut-off end. Special tokens are
    passed over."""
    i = 0
    while i < len(tokens):
        if tokens[i] <= RESUME:
            i += 1
        elif not TYPE0 <= tokens[i] < SIDE0:
            yield i, None
            i += 1
        elif i + 5 > len(tokens):
            yield i, None
            return
        else:
            yield i, tokens[i : i + 5]
            i += 5


def fields(t: list[int], size_edges: list[int], dt_edges: list[int]) -> tuple[int, str, int | None, int, int] | None:
    """(type, side, offset, size, gap) of a tuple; None if a token is out of its group."""
    kind, s, px, z, d = t
    if not (SIDE0 <= s < PX0 and (px == UNK or PX0 <= px <= PX_TAIL) and SIZE0 <= z <= SIZE0 + len(size_edges) and DT_ZERO <= d <= DT0 + len(dt_edges)):
        return None
    value = lambda b, edges: edges[0] - 1 if b == 0 else edges[b - 1]
    return kind, "BS"[s - SIDE0], None if px == UNK else px - PX0 - 1, value(z - SIZE0, size_edges), 0 if d == DT_ZERO else value(d - DT0, dt_edges)


OUTCOME = """stream long, seq long, kind string, side string, price long, shares long, reject string, why string, opened boolean, filled long, rested long, canceled long,
journal array<struct<msg_type:string,order_ref:long,side:string,shares:long,price:long>>, bid long, ask long, open_orders long, clock long"""
_JOURNAL = pa.list_(pa.struct([("msg_type", pa.string()), ("order_ref", pa.int64()), ("side", pa.string()), ("shares", pa.int64()), ("price", pa.int64())]))
_NAMES = [f.split()[0] for f in OUTCOME.split("journal")[0].replace("\n", " ").strip(" ,").split(",")] + ["journal", "bid", "ask", "open_orders", "clock"]
_KINDS = [{"kind": pa.string(), "side": pa.string(), "reject": pa.string(), "why": pa.string(), "opened": pa.bool_(), "journal": _JOURNAL}.get(n, pa.int64()) for n in _NAMES]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ("msg_type", "order_ref", "side", "shares", "price")
    rows = [(*r[:12], [dict(zip(names, j, strict=True)) for j in r[12]], *r[13:]) for r in rows]
    columns = zip(*rows, strict=True) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)


def closed_loop(actions: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """An ``OUTCOME`` row for each action (stream, seq, kind limit/market/cancel, side, price, shares), every stream
    against a book of its own. An action's own reference is its seq. Streams without an id have no book and are left out.
    """
    dealt = actions.where("stream IS NOT NULL").select("stream", "seq", "kind", "side", "price", "shares").repartition(F.xxhash64("stream")).sortWithinPartitions("stream", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, book = None, Book()
        for batch in batches:
            rows = []
            for stream, seq, kind, side, price, shares in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stream != now:
                    now, book = stream, Book()
                why, filled, rested, canceled, journal = submitted(book, seq, kind, side, price or 0, shares or 0, limits)
                rows.append((stream, seq, kind, side, price, shares, why, None, False, filled, rested, canceled, journal, book.best("B"), book.best("S"), len(book.orders), 0))
            yield _batch(rows)

    return dealt.mapInArrow(run, OUTCOME)


def token_loop(streams: DataFrame, seed_mid: int, tick: int = TICK, seed_shares: int = 100, limits: Limits = Limits()) -> DataFrame:
    """An ``OUTCOME`` row for each tuple of each token stream (stream, tokens, size_edges, dt_edges).

    Every stream starts from one order a side, a tick from ``seed_mid``. A bad token is a row with why Resync (or
    Truncated at the end), a tuple that can't be decoded DecodeFailed, hidden ones HiddenOrCross. ``clock`` adds up the
    decoded gaps, also those of rejected tuples. One row is a stream, so streams are cut to a bounded length.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream, tokens, sizes, gaps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                book, clock, rows = Book(), 0, []
                book.add(-1, "B", seed_shares, seed_mid - tick), book.add(-2, "S", seed_shares, seed_mid + tick)
                for n, (at, five) in enumerate(segments(tokens or [])):
                    e = fields(five, sizes, gaps) if five else None
                    kind, side, price, shares, opened = None, None, None, None, False
                    result, why = ("Unparseable", 0, 0, 0, []), None
                    if e is None:
                        why = "DecodeFailed" if five else "Truncated" if TYPE0 <= tokens[at] < SIDE0 else "Resync"
                    else:
                        clock += e[4]
                        side, shares = e[1], e[3]
                        if e[0] >= TYPE0 + 4:
                            why = "HiddenOrCross"
                        elif e[0] == TYPE0 + 3:
                            kind, side = "market", OTHER[side]
                            result = submitted(book, n, kind, side, 0, shares, limits)
                        else:
                            kind = "limit" if e[0] == TYPE0 else "cancel"
                            price, why, opened = resolved(book, e[0], side, e[2], tick)
                            result = ("UnknownReference", 0, 0, 0, []) if why else submitted(book, n, kind, side, price, shares, limits)
                    rows.append((stream, n, kind, side, price, shares, result[0], why, opened, *result[1:], book.best("B"), book.best("S"), len(book.orders), clock))
                for k in range(0, len(rows), 10_000):
                    yield _batch(rows[k : k + 10_000])

    return streams.select("stream", "tokens", "size_edges", "dt_edges").mapInArrow(run, OUTCOME)


def reject_counts(outcomes: DataFrame) -> DataFrame:
    """(stream, reject, why, n); applied ones have neither."""
    return outcomes.groupBy("stream", "reject", "why").agg(F.count("*").alias("n"))


def journal(outcomes: DataFrame) -> DataFrame:
    """The order messages that a stream's actions would send, as input for ``fold.replay``."""
    each = outcomes.select("stream", "seq", F.posexplode("journal").alias("k", "j"))
    c = lambda n: F.col(f"j.{n}").alias(n)
    own = F.when(F.col("j.msg_type") == "A", F.col("j.side"))
    return each.select(F.col("stream").alias("locate"), (F.col("seq") * 100_000 + F.col("k")).alias("seq"), F.col("seq").alias("us"), c("msg_type"), c("order_ref"), F.lit(None).cast("bigint").alias("new_ref"), own.alias("side"), c("shares"), c("price"))
