"""What each loss of the tokens does to a replay: one field at a time replaced by what its token says.

Sizes and gaps are replaced by column expressions before the fold (a bucket's representative; a clock summed up by a
window). Only what depends on the live book is decided inside: an add's price by its level index, and reductions that
go to the queue's head at a price instead of to their own order.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lobspark.functions.scalars import bucket, representative
from lobspark.operators.actions import level_price
from lobspark.operators.fold import Book
from lobspark.operators.series import by

#: Which fields a mode replaces.
MODES = {"none": set(), "dt": {"dt"}, "size": {"size"}, "pxadd": {"pxadd"}, "all": {"dt", "size", "pxadd"}, "noref": {"noref"}}


def substituted(events: DataFrame, mode: str) -> DataFrame:
    """events: locate, seq, us, etype, order_ref, side, price, size, has_px, lvl_off, dt, size_edges, dt_edges."""
    out = events
    if "size" in MODES[mode]:
        rep = representative(bucket(F.col("size"), F.col("size_edges")), F.col("size_edges"))
        out = out.withColumn("size", F.when(rep > 0, rep).otherwise(F.col("size")))
    if "dt" in MODES[mode]:
        gap = F.when(F.col("dt") > 0, F.greatest(F.lit(0), representative(bucket(F.col("dt"), F.col("dt_edges")), F.col("dt_edges")))).otherwise(0)
        w = by("locate").orderBy("us", "seq")
        start = F.first("us").over(w.rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn("clock", start + F.sum(F.when(F.row_number().over(w) == 1, 0).otherwise(gap)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        out = out.withColumn("clock", F.col("us"))
    return out.withColumn("by_level", F.lit("pxadd" in MODES[mode])).withColumn("by_queue", F.lit("noref" in MODES[mode]))


def queue_head(book: Book, side: str, price: int) -> int | None:
    """The oldest order at the price, or at the nearest occupied one (the better of two as near)."""
    p = book.prices[side]
    if not p:
        return None
    at = bisect_left(p, price)
    near = [p[k] for k in (at - 1, at) if 0 <= k < len(p)]
    best = min(near, key=lambda x: (abs(x - price), -x if side == "B" else x))
    return next(iter(book.levels[side][best]))


OUT = "locate long, seq long, clock long, outcome string, clamped boolean, price_moved boolean, ref_moved boolean, msg_type string, order_ref long, side string, shares long, price long"
_NAMES = [c.split()[0] for c in OUT.split(", ")]
_KINDS = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]] for c in OUT.split(", ")]


def _step(book: Book, e: dict) -> tuple:
    """(outcome, clamped, price_moved, ref_moved, type, ref, shares, price) of an event against the live book."""
    size, price, ref, side = e["size"] or 0, e["price"] or 0, e["order_ref"], e["side"]
    if e["etype"] == "Add":
        if e["by_level"] and e["has_px"] and e["lvl_off"] >= 0:
            price = level_price(book, side, e["lvl_off"]) or price
        moved = price != e["price"]
        if not size or not price:
            return "Zero", False, moved, False, None, ref, size, price
        fine = book.add(ref, side, size, price) == "Ok"
        return "Emitted" if fine else "Reject", False, moved, False, "A", ref, size, price
    own = queue_head(book, side, price) if e["by_queue"] else ref if ref in book.orders else None
    if own is None:
        return "NoOrder", False, False, False, None, ref, size, price
    have = book.orders[own][2]
    taken = have if e["etype"] == "Delete" else min(size, have)
    clamped = e["etype"] != "Delete" and size > have
    if not taken:
        return "Zero", clamped, False, own != ref, None, own, taken, price
    kind = {"Delete": "D", "PartialCancel": "X", "ExecVisible": "E"}[e["etype"]]
    book.reduce(own, taken, "executed" if kind == "E" else "canceled")
    return "Emitted", clamped, False, own != ref, kind, own, taken, price


def ablated(events: DataFrame, mode: str) -> DataFrame:
    """A row of ``OUT`` for each event under a mode; ``Emitted`` rows are the messages of the ablated stream."""
    cols = ["locate", "seq", "us", "etype", "order_ref", "side", "price", "size", "has_px", "lvl_off", "clock", "by_level", "by_queue"]
    dealt = substituted(events, mode).where("locate IS NOT NULL").select(*cols).repartition(F.xxhash64("locate")).sortWithinPartitions("locate", "us", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, book = None, Book()
        for batch in batches:
            rows = []
            for e in batch.to_pylist():
                if e["locate"] != now:
                    now, book = e["locate"], Book()
                o = _step(book, e)
                rows.append((e["locate"], e["seq"], e["clock"], *o[:6], e["side"], *o[6:]))
            columns = zip(*rows, strict=True) if rows else [()] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)

    return dealt.mapInArrow(run, OUT)


def accounting(ablation: DataFrame) -> DataFrame:
    """Emitted and skipped events by reason, clamped sizes, moved prices and references, by instrument."""
    of = lambda c: F.count_if(F.col("outcome") == c)
    return ablation.groupBy("locate").agg(
        of("Emitted").alias("emitted"),
        of("NoOrder").alias("no_order"),
        of("Zero").alias("zero"),
        of("Reject").alias("rejected"),
        F.count_if("clamped").alias("clamped"),
        F.count_if("price_moved").alias("price_moved"),
        F.count_if("ref_moved").alias("ref_moved"),
    )
