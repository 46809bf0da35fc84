"""Books with all reject rules, an instrument's stream cut into slices that run at once.

Whether a message is rejected depends on all before it, so a slice needs the book at its start: of the orders that its
messages name each with what it is then, of all others, which do not change in it, only the best bid and ask. Both
follow from how the slices before it leave the orders that they name. So slices run from the start that a guess of this
gives; then each slice's start is computed anew from what the slices before it have left, and slices whose
start has changed run again, until none has. Then every slice has run from the start that the slices before it leave,
and by induction all is as if run in one go. A slice that has orders wrong which others don't name changes no start of these,
so a few rounds are usual; there are never more than slices of an instrument and one.

The guess is a run of each slice by itself, in which orders that it names without having added them are taken to be there.

A slice's messages are packed once, some thousands to a row as compressed Arrow bytes, and so are their results, a byte each: a
round deals out packs and named orders, not messages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lobspark.operators import fold
from lobspark.sources.tables import checkpointed

#: What a slice's run adds to the columns of ``fold.SCHEMA``: what the message said, and where it stands (pos is the number of
#: the slice times ``SPAN``, and the number in it).
MORE = "new_ref long, said_shares long, said_price long, pos long, slice long"
#: Messages to a pack, and the most of a slice.
PACK, SPAN = 20_000, 1 << 32
#: Results by the byte that stands for them.
RESULTS = ["Ok", "ZeroShares", "DuplicateId", "WouldCross", "UnknownId", "TooManyShares", "BadReplace", "UnknownType"]
#: The result of a message that lacks what its type needs, for which ``fold.replay`` raises.
ERROR = "Error"
_CODE = {result: k for k, result in enumerate([*RESULTS, ERROR])}
#: What a run of slices gives: packs (of messages or of results, from the message at ``pos``), and the orders that a slice
#: names as it leaves them, NULLs if they aren't there. delta: for a guess, the change of an order that may be there.
OUT = "locate long, slice long, order_ref long, earlier boolean, side string, price long, shares long, pos long, delta long, packed binary"
#: Orders at the start of a slice, NULLs if they aren't there, and a row (best) with the best bid and ask of those it doesn't name.
START = ["locate", "slice", "best", "order_ref", "side", "price", "shares", "pos", "bid", "ask"]
#: Orders of the whole book at the start of a slice.
STATE = ["locate", "slice", "order_ref", "side", "price", "shares", "pos"]
#: Adds at the beginning of a slice from which a guess takes where bids and asks meet, and those for which it asks that.
MEET, WARM = 256, 64

_KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _fields(schema: str) -> list[tuple[str, pa.DataType]]:
    return [(name, _KINDS[kind]) for name, kind in (f.split() for f in schema.replace("\n", " ").split(","))]


def fitting(messages: DataFrame, least: int, slices: int = 64) -> int:
    """Messages to a slice, so that an instrument has at most so many slices, however long its stream is."""
    most = messages.where("locate IS NOT NULL").groupBy("locate").count().agg(F.max("count")).first()[0] or 0
    return max(least, -(-most // slices))


def values(column: pa.Array) -> list:
    """``column.to_pylist()``, of longs and strings by NumPy."""
    if pa.types.is_string(column.type):
        column = column.dictionary_encode()
        words = np.array([*column.dictionary.to_pylist(), None], dtype=object)
        return words[column.indices.fill_null(len(words) - 1).to_numpy(zero_copy_only=False)].tolist()
    if not pa.types.is_int64(column.type):
        return column.to_pylist()
    if not column.null_count:
        return column.to_numpy().tolist()
    out = column.fill_null(0).to_numpy().astype(object)
    out[column.is_null().to_numpy(zero_copy_only=False)] = None
    return out.tolist()


def packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def unpacked(pack: bytes) -> pa.Table:
    return pa.ipc.open_stream(pack).read_all().combine_chunks()


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.Table]]:
    """Rows that come sorted by locate, as stretches of at most ``PACK`` rows of one locate, and whether a locate begins."""
    held, size, now, first = [], 0, None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        of = batch["locate"].to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for a, b in zip(edges, edges[1:]):
            if held and of[a] != now:
                yield first, pa.Table.from_batches(held).combine_chunks()
                held, size, first = [], 0, True
            now = of[a]
            while a < b:
                n = min(b - a, PACK - size)
                held.append(batch.slice(a, n))
                a, size = a + n, size + n
                if size == PACK:
                    yield first, pa.Table.from_batches(held).combine_chunks()
                    held, size, first = [], 0, False
    if held:
        yield first, pa.Table.from_batches(held).combine_chunks()


class Part(fold.Book):
    """The orders that a slice names, beside others of which the best of each side are known."""

    def __init__(self):
        super().__init__()
        self.others: dict[str, int | None] = {"B": None, "S": None}
        self.pos: dict[int, int] = {}  # of the message that an order came with

    def best(self, side: str) -> int | None:
        prices, other = self.prices[side], self.others[side]
        if not prices:
            return other
        own = prices[-1] if side == "B" else prices[0]
        return own if other is None or (own > other if side == "B" else own < other) else other

    def take(self, t: str, ref: int, new: int, side: str, shares: int, price: int, pos: int) -> str:
        try:
            result = self.apply(t, ref, new, side, shares, price)
        except (KeyError, TypeError):  # an error only if no later round finds that the message is refused before
            return ERROR
        if result == "Ok":
            if t in ("A", "F"):
                self.pos[ref] = pos
            elif t == "U":
                self.pos[new] = pos
        return result


def middle(adds: list[tuple[str, int]]) -> float | None:
    """The price between those of (side, price) that the fewest are on the wrong side of, and of such the one in the widest gap."""
    prices = sorted({p for _, p in adds})
    if len(prices) < 2:
        return prices[0] if prices else None
    wrong = lambda c: sum(p > c if s == "B" else p < c for s, p in adds)
    return min((wrong((a + b) / 2), a - b, (a + b) / 2) for a, b in zip([prices[0] - 1, *prices], [*prices, prices[-1] + 1]))[2]


class Guess(Part):
    """A slice by itself: orders that aren't known to be there or not are taken to be there where they are reduced or replaced, and
    not to be where they are added. ``named`` has their change so far, and None for what is known."""

    def __init__(self, adds: list[tuple[str, int]]):
        super().__init__()
        self.named: dict[int, int | None] = {}
        self.mid, self.left = middle(adds), min(WARM, len(adds))

    def take(self, t: str, ref: int, new: int, side: str, shares: int, price: int, pos: int) -> str:
        known = self.named.setdefault(ref, 0) is None
        if t in ("A", "F"):
            if self.left and price is not None:  # the book of the slice alone is too empty yet to refuse what crosses
                self.left -= 1
                if price > self.mid if side == "B" else price < self.mid:
                    return "WouldCross"
        elif t == "U":
            self.named.setdefault(new, 0)
            if not known and ref != new:
                self.named[ref] = None
                side = self.side_of(price) if price is not None else None
                if side and new not in self.orders and (shares or 0) > 0 and not self.crosses(side, price):
                    self.rest(new, side, shares, price)
                    self.named[new], self.pos[new] = None, pos
                return "Ok"
        elif not known and t in ("E", "C", "X"):
            self.named[ref] -= max(shares or 0, 0)
            return "Ok"
        elif not known and t == "D":
            self.named[ref] = None
            return "Ok"
        result = super().take(t, ref, new, side, shares, price, pos)
        if result == "Ok" and t in ("A", "F", "U"):
            self.named[new if t == "U" else ref] = None
        return result

    def side_of(self, price: int) -> str | None:
        bid, ask = self.best("B"), self.best("S")
        if self.mid is None:
            self.mid = bid if ask is None else ask
        if self.mid is None:
            return None
        return "B" if bid is not None and price <= bid or (ask is None or price < ask) and price <= self.mid else "S"


class _Rows:
    """Rows of ``OUT`` by columns."""

    def __init__(self):
        self.columns: list[list] = [[] for _ in _fields(OUT)]

    def add(self, n: int, *columns) -> None:
        for held, of in zip(self.columns, columns, strict=True):
            held.extend(of if isinstance(of, list) else [of] * n)

    def orders(self, key: tuple[int, int], book: Part, refs, earlier: bool | None = None, deltas: list | None = None) -> None:
        refs = list(refs)
        side, price, shares = ([o and o[k] for o in map(book.orders.get, refs)] for k in range(3))
        self.add(len(refs), *key, refs, earlier, side, price, shares, [book.pos[r] if o else None for r, o in zip(refs, side)], deltas, None)

    def pack(self, key: tuple[int, int], pos: int, pack: bytes) -> None:
        self.add(1, *key, None, None, None, None, None, pos, None, pack)

    def batches(self, least: int = 10_000) -> Iterator[pa.RecordBatch]:
        n = len(self.columns[0])
        if n >= least:
            whole = pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(self.columns, _fields(OUT), strict=True)], [n for n, _ in _fields(OUT)])
            self.__init__()
            for at in range(0, n, 10_000):
                yield whole.slice(at, 10_000)


_NAMES = [f for f in fold.Message._fields if f != "locate"]
_SAID = ["msg_type", "order_ref", "new_ref", "side", "shares", "price"]


def guessed(messages: DataFrame, slice_messages: int) -> DataFrame:
    """``OUT``: the packs of slices of about so many messages, and the orders that each names as a run of it alone leaves them.

    Slices are ranges of (locate, us, seq), so that no task holds an instrument.
    """
    n = max(1, messages.count() // slice_messages)
    dealt = messages.select("locate", *_NAMES).repartitionByRange(n, "locate", "us", "seq").sortWithinPartitions("locate", "us", "seq")
    dealt = dealt.withColumn("slice", F.spark_partition_id().cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, book = _Rows(), None, None
        for begins, rows in _stretches(batches):
            said = list(zip(*(values(rows[c].chunk(0)) for c in _SAID), strict=True))
            if begins:
                if book:
                    out.orders(key, book, book.named, deltas=list(book.named.values()))
                key = (rows["locate"][0].as_py(), rows["slice"][0].as_py())
                pos = key[1] * SPAN
                book = Guess([(m[3], m[5]) for m in said if m[0] in ("A", "F") and m[5] is not None][:MEET])
            out.pack(key, pos, packed(rows.select(_NAMES).to_batches()[0]))
            for pos, m in enumerate(said, pos):  # noqa: B020
                book.take(*m, pos)
            pos += 1
            yield from out.batches()
        if book:
            out.orders(key, book, book.named, deltas=list(book.named.values()))
        yield from out.batches(1)

    return dealt.mapInArrow(run, OUT)


def left_by_guess(out: DataFrame) -> DataFrame:
    """The orders of ``guessed`` as ``run_slices`` gives them, changes of orders from earlier slices counted in."""
    w = Window.partitionBy("locate", "order_ref").orderBy("slice")
    known = F.struct("side", "price", "shares", "pos", "run")
    named = out.where("packed IS NULL").withColumns({"run": F.sum(F.coalesce("delta", F.lit(0))).over(w), "earlier": F.row_number().over(w) > 1})
    named = named.withColumn("s", F.last(F.when(F.col("delta").isNull(), known), ignorenulls=True).over(w))
    shares = F.col("s.shares") + F.col("run") - F.col("s.run")
    there = F.col("s.side").isNotNull() & (shares > 0)
    state = {"side": F.col("s.side"), "price": F.col("s.price"), "shares": shares, "pos": F.col("s.pos")}
    named = named.select("locate", "slice", "order_ref", "earlier", *(F.when(there, x).alias(name) for name, x in state.items()))
    return named.where("earlier OR side IS NOT NULL")


def starts(left: DataFrame, last: DataFrame) -> DataFrame:
    """``START``: what each slice starts from, if the slices leave the orders that they name like this.

    left: orders of ``OUT``, those that aren't there only if a slice before names them too. last: (locate, last), an instrument's last slice.
    """
    w = Window.partitionBy("locate", "order_ref").orderBy("slice")
    # until: the last slice before the one that names the order next
    orders = left.withColumns({"until": F.lead("slice").over(w) - 1, "was": F.lag(F.struct("side", "price", "shares", "pos")).over(w)})
    orders = checkpointed(orders.where("earlier OR until IS NULL OR slice < until").select("locate", "slice", "order_ref", "earlier", "side", "price", "until", "was"))
    named = orders.where("earlier").select("locate", "slice", F.lit(False).alias("best"), "order_ref", "was.side", "was.price", "was.shares", "was.pos")
    # others only by the slices that they rest through: no more rows than pairs of slices
    rest = orders.where("side IS NOT NULL AND (until IS NULL OR slice < until)").groupBy("locate", "slice", "until")
    rest = rest.agg(F.max(F.when(F.col("side") == "B", F.col("price"))).alias("bid"), F.min(F.when(F.col("side") == "S", F.col("price"))).alias("ask")).join(last, "locate")
    rest = rest.withColumn("until", F.coalesce("until", "last")).where("slice < until")
    rest = rest.select("locate", F.explode(F.sequence(F.col("slice") + 1, "until")).alias("slice"), "bid", "ask")
    rest = rest.groupBy("locate", "slice").agg(F.lit(True).alias("best"), F.max("bid").alias("bid"), F.min("ask").alias("ask"))
    return named.unionByName(rest, allowMissingColumns=True).select(*START)


def books(left: DataFrame, last: DataFrame) -> DataFrame:
    """All orders of each slice's book at its start (``STATE``): an order is carried to every slice that it rests through, which is
    what handing each slice its whole book takes; slices should be longer than books are deep."""
    w = Window.partitionBy("locate", "order_ref").orderBy("slice")
    held = left.withColumn("until", F.lead("slice").over(w)).where("side IS NOT NULL").join(last, "locate")
    held = held.withColumn("until", F.coalesce("until", "last")).where("slice < until")
    return held.select("locate", F.explode(F.sequence(F.col("slice") + 1, "until")).alias("slice"), *STATE[2:])


def prints(start: DataFrame) -> DataFrame:
    """(locate, slice, print): equal for equal starts."""
    lanes = [F.bit_xor(F.xxhash64(F.lit(k), *START[2:])) for k in (1, 2)]
    return start.groupBy("locate", "slice").agg(F.struct(F.count("*").alias("n"), *(x.alias(f"x{k}") for k, x in enumerate(lanes))).alias("print"))


def _dealt(both: DataFrame, slices: int) -> DataFrame:
    """Rows by slice, orders by arrival and then packs. As many tasks as may be of use: few rows look small to Spark."""
    conf = both.sparkSession.conf.get("spark.sql.shuffle.partitions")
    n = max(1, min(slices, max(int(conf), 4 * both.sparkSession.sparkContext.defaultParallelism)))
    # by a hash of the key: Spark 4.1 leaves out a dealing by the key itself after a union of joins on it, also where
    # each join's partitions were coalesced in another way, and then a slice's rows are apart
    return both.repartition(n, F.xxhash64("locate", "slice")).sortWithinPartitions("locate", "slice", F.col("packed").isNotNull(), "pos")


def run_slices(packs: DataFrame, start: DataFrame, slices: int) -> DataFrame:
    """``OUT``: each slice run from its start: packs of its messages' results, and the orders that it names as it leaves them."""
    both = packs.unionByName(start, allowMissingColumns=True).select(*START, "packed")
    dealt = _dealt(both, slices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, book, earlier = _Rows(), None, Part(), {}

        def leave() -> None:
            out.orders(now, book, earlier, True)
            out.orders(now, book, [ref for ref in book.orders if ref not in earlier], False)

        for batch in batches:
            for locate, part, best, ref, side, price, shares, pos, bid, ask, pack in zip(*(values(c) for c in batch.columns), strict=True):
                if (locate, part) != now:
                    if now:
                        leave()
                    now, book, earlier = (locate, part), Part(), {}
                if pack is not None:
                    rows = unpacked(pack)
                    said = zip(*(values(rows[c].chunk(0)) for c in _SAID), strict=True)
                    out.pack(now, pos, bytes([_CODE[book.take(*m, at)] for at, m in enumerate(said, pos)]))
                elif best:
                    # of a guessed book they may cross, and then one of them is wrong
                    if bid is None or ask is None or bid < ask:
                        book.others = {"B": bid, "S": ask}
                else:
                    earlier[ref] = None
                    if side is not None:
                        book.rest(ref, side, shares, price)
                        book.pos[ref] = pos
            yield from out.batches()
        if now:
            leave()
        yield from out.batches(1)

    return dealt.mapInArrow(run, OUT)


def opened(packs: DataFrame, columns: list[str]) -> DataFrame:
    """(locate, slice, pos, result, and these columns of the messages), a row a message of (locate, slice, pos, packed, results)."""
    kinds = dict(_fields("seq long, us long, msg_type string, order_ref long, new_ref long, side string, shares long, price long"))
    names = {v: k for k, v in _KINDS.items()}
    schema = ", ".join(["locate long", "slice long", "pos long", "result string", *(f"{c} {names[kinds[c]]}" for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(RESULTS)
        for batch in batches:
            for row in zip(*(values(batch[c]) for c in ("locate", "slice", "pos", "packed", "results")), strict=True):
                locate, part, pos, pack, codes = row
                if _CODE[ERROR] in codes:
                    raise ValueError(f"locate {locate}: a message lacks what its type needs")
                rows, n = unpacked(pack), len(codes)
                cells = [pa.array(np.full(n, locate)), pa.array(np.full(n, part)), pa.array(np.arange(pos, pos + n)), words.take(pa.array(np.frombuffer(codes, dtype=np.uint8)))]
                yield pa.RecordBatch.from_arrays([*cells, *(rows[c].chunk(0) for c in columns)], ["locate", "slice", "pos", "result", *columns])

    return packs.select("locate", "slice", "pos", "packed", "results").mapInArrow(run, schema)


def verdicts(messages: DataFrame, slice_messages: int = 200_000) -> tuple[DataFrame, DataFrame, DataFrame, list[int]]:
    """The result of each message, from slices of about so many messages, as packs for ``opened``; the orders that each slice names, as
    it leaves them; (locate, last), an instrument's last slice; and how many slices each round ran.

    messages: as for ``fold.replay``. The driver sees only the numbers of slices.
    """
    alone = checkpointed(guessed(messages.where("locate IS NOT NULL"), slice_messages))
    packs = checkpointed(alone.where("packed IS NOT NULL").select("locate", "slice", "pos", "packed"))
    every = checkpointed(packs.select("locate", "slice").distinct())
    last = checkpointed(every.groupBy("locate").agg(F.max("slice").alias("last")))
    start = checkpointed(starts(left_by_guess(alone), last))
    rounds = [every.count()]
    out = checkpointed(run_slices(packs, start, rounds[0]))
    known = checkpointed(every.join(prints(start), ["locate", "slice"], "left"))
    while rounds[-1]:
        start = checkpointed(starts(out.where("packed IS NULL"), last))
        fresh = checkpointed(every.join(prints(start), ["locate", "slice"], "left"))
        had = known.withColumnRenamed("print", "had")
        changed = checkpointed(fresh.join(had, ["locate", "slice"]).where(~F.col("print").eqNullSafe(F.col("had"))).select("locate", "slice"))
        rounds.append(changed.count())
        if rounds[-1]:
            of = lambda df: df.join(F.broadcast(changed), ["locate", "slice"], "left_semi")
            again = run_slices(of(packs), of(start), rounds[-1])
            out = checkpointed(out.join(F.broadcast(changed), ["locate", "slice"], "left_anti").unionByName(again))
            known = fresh
    results = out.where("packed IS NOT NULL").select("locate", "slice", "pos", F.col("packed").alias("results"))
    return packs.join(results, ["locate", "slice", "pos"]), out.where("packed IS NULL"), last, rounds


def replay(messages: DataFrame, slice_messages: int = 200_000) -> tuple[DataFrame, list[int]]:
    """``fold.replay``'s rows with ``MORE``, and how many slices each round of ``verdicts`` ran: once the results are known, each slice
    runs once from its whole book."""
    packs, left, last, rounds = verdicts(messages, slice_messages)
    both = packs.select("locate", "slice", "pos", "packed").unionByName(books(left, last), allowMissingColumns=True)
    dealt = _dealt(both.select(*STATE, "packed"), rounds[0])
    schema = f"{fold.SCHEMA}, {MORE}"
    names, kinds = zip(*_fields(schema), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, fold.Book()
        for batch in batches:
            for locate, part, ref, side, price, shares, pos, pack in zip(*(values(c) for c in batch.columns), strict=True):
                if (locate, part) != now:
                    now, held = (locate, part), fold.Book()
                if pack is None:
                    held.rest(ref, side, shares, price)
                    continue
                rows = unpacked(pack)
                said = [fold.Message(locate, *m) for m in zip(*(values(rows[c].chunk(0)) for c in _NAMES), strict=True)]
                cells = zip(*((*fold.step(held, m), m.new_ref, m.shares, m.price, at, part) for at, m in enumerate(said, pos)), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], list(names))

    return dealt.mapInArrow(run, schema), rounds
