"""Streaming forms: books and sign decisions as keyed state, and windowed sampling behind a watermark.

Within an instrument messages must be applied in order. A micro-batch's rows are sorted by (us, seq) inside the
group; rows older than what was applied already are late, don't change the state, and come out with result "Late".
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lobspark.operators.fold import Book, Message

BOOK_OUT = "locate long, seq long, us long, msg_type string, result string, bid long, bid_shares long, ask long, ask_shares long, open_orders long"


def _rows(frames: Iterator[pd.DataFrame], columns: list[str], order: list[str]) -> list[tuple]:
    all_rows = pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable")
    return [tuple(None if pd.isna(v) else v for v in row) for row in all_rows[columns].itertuples(index=False)]


def live_books(messages: DataFrame) -> DataFrame:
    """The touch after every message, from a stream of (locate, seq, us, msg_type, order_ref, new_ref, side, shares,
    price). The state of an instrument is its book; the checkpoint makes it survive a lost executor."""

    def apply(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        book, last = pickle.loads(state.get[0]) if state.exists else (Book(), (-1, -1))
        out = []
        for row in _rows(frames, list(Message._fields), ["us", "seq"]):
            m = Message(*(int(v) if isinstance(v, float) else v for v in row))
            if (m.us, m.seq) <= last:
                result = "Late"
            else:
                last = (m.us, m.seq)
                result = book.apply(m.msg_type, m.order_ref, m.new_ref, m.side, m.shares, m.price)
            bid, ask = book.best("B"), book.best("S")
            out.append((m.locate, m.seq, m.us, m.msg_type, result, bid, bid and book.depth["B", bid], ask, ask and book.depth["S", ask], len(book.orders)))
        state.update((pickle.dumps((book, last), 5),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in BOOK_OUT.split(", ")]).astype({c: "Int64" for c in ("bid", "bid_shares", "ask", "ask_shares")})

    # pandas has no NULL integers: a missing number must not turn its column into floating point
    whole = messages.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("new_ref", "shares", "price")} | {"order_ref": F.coalesce("order_ref", F.lit(-1))})
    return whole.groupBy("locate").applyInPandasWithState(apply, BOOK_OUT, "book binary", "append", GroupStateTimeout.NoTimeout)


def live_decisions(fills: DataFrame, window: int) -> DataFrame:
    """Closed sign decisions from a stream of (symbol, ts, seq, sign, shares): a decision comes out when the fill that
    ends it arrives. The gap rule is the batch one (over ``window``, exact), which session windows can't say."""
    schema = "symbol long, sign long, ts long, fills long, shares long"

    def apply(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sign, began, last, n, total = state.get if state.exists else (0, 0, 0, 0, 0)
        out = []
        for ts, _, s, shares in _rows(frames, ["ts", "seq", "sign", "shares"], ["ts", "seq"]):
            if n and (s != sign or ts - last > window):
                out.append((key[0], sign, began, n, total))
                n = 0
            if not n:
                sign, began, total = s, ts, 0
            last, n, total = ts, n + 1, total + shares
        state.update((int(sign), int(began), int(last), int(n), int(total)))
        yield pd.DataFrame(out, columns=["symbol", "sign", "ts", "fills", "shares"])

    return fills.groupBy("symbol").applyInPandasWithState(apply, schema, "sign long, began long, last long, n long, total long", "append", GroupStateTimeout.NoTimeout)


def sampled(touches: DataFrame, every: str = "1 minute", delay: str = "5 minutes") -> DataFrame:
    """The last two-sided touch of each interval, once the watermark has passed it: (locate, start, bid, ask, n).

    touches: (locate, time timestamp, seq, bid, ask). Rows behind the watermark are dropped by Spark.
    """
    last = F.max(F.struct("time", "seq", "bid", "ask"))
    w = touches.withWatermark("time", delay).where("bid IS NOT NULL AND ask IS NOT NULL").groupBy("locate", F.window("time", every).alias("w"))
    return w.agg(last.alias("l"), F.count("*").alias("n")).select("locate", F.col("w.start").alias("start"), "l.bid", "l.ask", "n")
