"""Slices against the fold, prefix scans, lineage, audits of books broken in each way, fingerprints and strict replay."""

import random

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from lobspark.operators import ablation, book, calibration, fold, integrity, lineage, scan, selection, series, slices
from lobspark.plans.books import feed

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("size", [40, 10_000])
def test_slices_equal_the_fold(spark, size):
    noisy = book.noisy_feed(feed(spark, SF)).where("locate <= 2")
    got, rounds = slices.replay(noisy, size)
    want = fold.replay(noisy)
    a, b = got.select(*want.columns), want
    assert a.count() == b.count() and not a.exceptAll(b).count()
    assert rounds[-1] == 0 and (rounds[0] > 10 if size == 40 else len(rounds) == 2)


def test_slices_of_a_chain_of_replaces(spark):
    """Orders that came into being by replaces are handed on with their side and their place in the queue."""
    rows = [(1, 1, 1, "A", 1, None, "S", 500, 900), (1, 2, 2, "A", 50, None, "S", 10, 900)]
    rows += [(1, k, k, "U", k - 2, k - 1, None, 500 - k, 900) for k in range(3, 40)]
    rows += [(1, 40, 40, "A", 99, None, "B", 5, 900), (1, 41, 41, "E", 38, None, None, 461, None), (1, 42, 42, "A", 99, None, "B", 5, 900), (1, 43, 43, "D", 50, None, None, None, None), (1, 44, 44, "A", 99, None, "B", 5, 900)]
    df = spark.createDataFrame(rows, "locate long, seq long, us long, msg_type string, order_ref long, new_ref long, side string, shares long, price long")
    got, rounds = slices.replay(df, 4)
    want = fold.replay(df)
    assert not got.select(*want.columns).exceptAll(want).count()
    assert {r.seq: r.result for r in got.collect() if r.seq >= 40} == {40: "WouldCross", 41: "Ok", 42: "WouldCross", 43: "Ok", 44: "Ok"}


def test_slices_of_nothing(spark):
    df = spark.createDataFrame([], "locate long, seq long, us long, msg_type string, order_ref long, new_ref long, side string, shares long, price long")
    got, rounds = slices.replay(df)
    assert got.count() == 0 and rounds == [0]


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_running_sums(spark, keys):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), i * 7 % 1000, rng.choice([None, 1, 2, -3])) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, t long, v long").repartition(3)
    got = {r.t: (r.s, r.n) for r in scan.running(df, ["t"], {"s": F.col("v"), "n": F.lit(1)}, keys).collect()}
    sums: dict = {}
    for k, t, v in sorted(rows, key=lambda r: r[1]):
        if keys and k is None:
            continue
        s, n = sums.get(k if keys else 0, (0, 0))
        sums[k if keys else 0] = s, n = s + (v or 0), n + 1
        assert got[t] == (s, n)


def test_a_hot_key_is_many_ranges(spark):
    df = spark.range(5000).selectExpr("1L AS k", "id AS t")
    plan = scan.numbered(df, ["t"], "n", ("k",))
    assert plan.where("n <> t + 1").count() == 0
    sizes = df.repartitionByRange(4, "k", "t").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 2500


def test_peaks_despite_rejects(spark):
    noisy = book.noisy_feed(feed(spark, SF))
    rows = fold.replay(noisy)
    got = scan.peaks(rows).first()
    open_now, peak = {}, 0
    for r in sorted(rows.collect(), key=lambda r: (r.us, r.seq)):
        open_now[r.locate] = r.open_orders
        peak = max(peak, sum(open_now.values())) if r.result == "Ok" else peak
    assert (got.messages, got.books_touched, got.peak_open_total) == (rows.count(), len(open_now), peak)


def test_roots_of_long_chains(spark):
    edges = [(1, k, k + 1) for k in range(1000)] + [(2, k, k + 1) for k in range(7)] + [(2, 100, 101)]
    random.Random(1).shuffle(edges)
    got = {(r.locate, r.ref): (r.root, r.hops) for r in lineage.roots(spark.createDataFrame(edges, "locate long, old long, new long")).collect()}
    assert got == {(1, k): (0, k) for k in range(1, 1001)} | {(2, k): (0, k) for k in range(1, 8)} | {(2, 101): (100, 1)}


def test_a_circle_of_replaces_raises(spark):
    with pytest.raises(ValueError, match="circle"):
        lineage.roots(spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 1), (1, 3, 4)], "locate long, old long, new long"))
    assert lineage.roots(spark.createDataFrame([], "locate long, old long, new long")).count() == 0


ORDERS = [(1, "B", 100, 1, 50, 1, 5), (1, "B", 100, 2, 30, 2, 8), (1, "S", 110, 3, 20, 1, 6), (2, "B", 90, 4, 10, 1, 2)]
LEVELS = [(1, "B", 100, 80, 2), (1, "S", 110, 20, 1), (2, "B", 90, 10, 1)]
LEDGER = [(1, 150, 40, 10), (2, 10, 0, 0), (3, 5, 5, 0)]


@pytest.mark.parametrize(
    "orders,levels,ledger,found",
    [
        ({}, {}, {}, {}),
        ({1: (1, "B", 100, 2, 31, 2, 8)}, {}, {0: (1, 151, 40, 10)}, {"level_shares": 1}),
        ({1: (1, "B", 100, 2, 0, 2, 8)}, {0: (1, "B", 100, 50, 2)}, {0: (1, 120, 40, 10)}, {"no_shares": 1}),
        ({}, {0: (1, "B", 100, 80, 3)}, {}, {"level_orders": 1}),
        ({1: (1, "B", 100, 2, 30, 2, 4)}, {}, {}, {"queue_order": 1}),
        ({1: (1, "B", 100, 2, 30, 2, None)}, {}, {}, {"queue_order": 1}),
        ({2: (1, "S", 100, 3, 20, 1, 6)}, {1: (1, "S", 100, 20, 1)}, {}, {"crossed": 1}),
        ({}, {}, {2: (3, 6, 5, 0)}, {"conservation": 1}),
        ({}, {2: (2, "B", 91, 10, 1)}, {}, {"level_shares": 2, "level_orders": 2, "levels": 4}),
        ({3: None}, {}, {}, {"level_shares": 1, "level_orders": 1, "conservation": 1, "orders": 3}),
    ],
)
def test_audit_finds_each_fault(spark, orders, levels, ledger, found):
    broken = lambda rows, by: [r for i, r in enumerate(rows) for r in [by.get(i, r)] if r]
    o = spark.createDataFrame(broken(ORDERS, orders), "locate long, side string, price long, order_ref long, shares long, ord long, arrival long")
    lv = spark.createDataFrame(broken(LEVELS, levels), "locate long, side string, price long, shares long, orders long")
    g = spark.createDataFrame(broken(LEDGER, ledger), "locate long, added long, executed long, canceled long")
    got = {r.name: r.n for r in integrity.audited(o, lv, g).collect()}
    assert got == dict.fromkeys(integrity.CHECKS, 0) | {"levels": 3, "orders": 4, "books": 3} | found


def test_fingerprints_tell_changed_feeds_apart(spark):
    m = feed(spark, SF).where("locate = 1").cache()
    rows = lambda df: [tuple(r)[3:] for r in integrity.fingerprints(df).orderBy("pos").collect()]
    plain = rows(m)
    assert plain == rows(m.repartition(5)) and len(plain) > 60
    seqs = [r.seq for r in m.orderBy("us", "seq").collect()]
    for change in ({"shares": F.col("shares") + 1}, {"price": F.col("price") + 100}, {"side": F.lit("S")}):
        adds = {r.seq for r in m.where("msg_type IN ('A', 'F') AND side = 'B'").collect()}
        at = next(i for i, s in enumerate(seqs) if i > 20 and s in adds)
        other = rows(m.withColumns({c: F.when(F.col("seq") == seqs[at], x).otherwise(F.col(c)) for c, x in change.items()}))
        assert other[:at] == plain[:at] and all(x[-1] != y[-1] for x, y in zip(other[at:], plain[at:], strict=True))
        assert other[at][:2] != plain[at][:2]


def test_strict_replay_names_what_is_wrong(spark):
    events = integrity.recorded(feed(spark, SF).where("locate <= 3")).cache()
    assert integrity.mismatches(events).where("any").count() == 0
    for kind, what in (("px", "px"), ("size", "order"), ("dt", "dt_off")):
        wrong = integrity.mismatches(integrity.mutated(events, kind, 5)).where("any").collect()
        assert len(wrong) == 3 and all(r[what] and not any(r[o] for o in ("reject", "px", "order", "dt_off") if o != what) for r in wrong)
    lost = events.where("NOT (msg_type IN ('A', 'F') AND place = 1)")  # an add is gone: what refers to it is refused
    assert integrity.mismatches(lost).where("any").count() > 0


def test_contexts_of_rejects(spark):
    rows = [(1, k, k, "X", k, "Ok" if k % 4 else "UnknownId", None, None, None, None, 0) for k in range(1, 14)]
    df = spark.createDataFrame(rows, "locate long, seq long, us long, msg_type string, order_ref long, result string, side string, price long, bid long, ask long, open_orders long")
    got = [(r.seq, r.nth, r.before, r.after) for r in integrity.reject_contexts(df, 2, 1).orderBy("nth").collect()]
    assert got == [(4, 1, "3:X:Ok", "5:X:Ok"), (8, 2, "7:X:Ok", "9:X:Ok")]


def draws(kind, n, rng):
    return {
        "double": lambda: rng.choice([rng.gauss(0, 1), rng.gauss(0, 1) * 1e-9, 3.5, 1e300 * rng.random(), -1e300]),
        "few": lambda: rng.choice([1.0, 2.0, 2.5]),
        "long": lambda: rng.choice([rng.randint(-10, 10), rng.randint(-(2**62), 2**62), 2**53 + rng.randint(0, 3)]),
    }[kind]


@pytest.mark.parametrize("kind", ["double", "few", "long"])
@pytest.mark.parametrize("size", [700, 6000])
def test_order_statistics_by_cells(spark, kind, size):
    """Keys with more values than may be sorted together, at two sizes; ties, extremes, small keys and keys of one value."""
    rng = random.Random(size)
    draw = draws(kind, size, rng)
    rows = [("hot", draw()) for _ in range(size)] + [("b", draw()) for _ in range(60)] + [("one", draw()), ("none", None), (None, draw())]
    df = spark.createDataFrame(rows, f"k string, x {'long' if kind == 'long' else 'double'}").repartition(4)
    wanted = {"least": F.lit(0), "low": F.floor(F.col("n") * 0.1), "mid": F.floor(F.col("n") / 2), "most": F.col("n") - 1, "beyond": F.col("n"), "below": F.lit(-1)}
    got = {r.k: tuple(r)[1:] for r in selection.order_statistics(df, "k", "x", wanted, least=50).collect() if r.k}
    values = {k: sorted(x for q, x in rows if q == k) for k in ("hot", "b", "one")}
    assert got == {k: (v[0], v[int(len(v) * 0.1)], v[len(v) // 2], v[-1], None, None) for k, v in values.items()}


def test_top_sums(spark):
    rows = [("a", x) for x in [1.0, 2.0, 4.0, 4.0, 4.0, 8.0]] + [("b", 3.0)]
    got = {r.k: tuple(r)[1:] for r in selection.top_sums(spark.createDataFrame(rows, "k string, x double"), "k", "x", F.lit(3), lambda x, edge: x).collect()}
    assert got == {"a": (6, 3, 4.0, 16.0), "b": (1, 1, 3.0, 3.0)}


def test_a_fold_deals_its_rows_after_a_join_on_the_key(spark):
    """Spark leaves out a dealing by a join's own key, and then reads the rows where they lie if the join turns into a broadcast."""
    messages = feed(spark, SF).withColumn("new_ref", F.lit(None).cast("bigint"))
    joined = messages.join(messages.groupBy("locate").agg(F.max("seq").alias("most")).hint("merge"), "locate")
    plan = fold.replay(joined)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("REPARTITION_BY_COL") < plan.index("SortMergeJoin")


def test_exposure_broadcasts_no_rows_that_grow_with_messages(spark):
    """Exploded rows look small to Spark: one row an instrument may be broadcast, the stretches and messages are merged."""
    plan = calibration.exposure(feed(spark, SF))._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join [" in line]
    assert sum("SortMergeJoin" in j for j in joins) >= 3
    assert not any("BroadcastHashJoin" in j and ("node#" in j or "pos#" in j) for j in joins)


def test_slices_grow_with_the_stream(spark):
    """An instrument has at most so many slices, each of which is handed its book; the results are the fold's."""
    noisy = book.noisy_feed(feed(spark, SF)).where("locate <= 2")
    size = slices.fitting(noisy, 1, 4)
    assert size == -(-max(r["count"] for r in noisy.groupBy("locate").count().collect()) // 4) and slices.fitting(noisy, 10_000) == 10_000
    got, rounds = slices.replay(noisy, size)
    want = fold.replay(noisy)
    assert rounds[0] <= 8 and rounds[-1] == 0
    assert got.count() == want.count() and not got.select(*want.columns).exceptAll(want).count()


def test_both_replays_of_what_was_accepted_read_it_once(spark, monkeypatch):
    """The fold that says what is accepted runs once, not again for each of the two replays."""
    plans = []
    through = fold.replay
    monkeypatch.setattr(fold, "replay", lambda m: plans.append(m._jdf.queryExecution().optimizedPlan().toString()) or through(m))
    queries()["b13_accepted_replay"](spark, SF)
    assert len(plans) == 2 and "MapInArrow" not in plans[1]


def test_ablation_modes_read_the_tokens_once(spark, monkeypatch):
    """The book is replayed once, and the modes read stored events."""
    plans, replays = [], []
    through, replay = ablation.ablated, book.replay
    monkeypatch.setattr(ablation, "ablated", lambda e, mode: plans.append(e._jdf.queryExecution().optimizedPlan().toString()) or through(e, mode))
    monkeypatch.setattr(book, "replay", lambda *a, **k: replays.append(1) or replay(*a, **k))
    queries()["r01_ablation_modes"](spark, SF)
    assert len(replays) == 1 and len(plans) == 5 and not any("Window" in p or "Join" in p for p in plans)


@pytest.mark.parametrize("block", [1, 3, 50_000])
def test_series_are_numbered_and_compared_in_parts(spark, block):
    rng = random.Random(5)
    rows = [(k % 3 or None, rng.randint(0, 60), k, rng.choice([None, 10.0, 20.0])) for k in range(200)]
    df = series.ordered(spark.createDataFrame(rows, "symbol long, ts long, seq long, mid double").repartition(5), "ts", "seq")
    want = []
    for symbol in (1, 2, None):
        last, own = None, sorted((r for r in rows if r[0] == symbol), key=lambda r: r[1:3])
        for i, r in enumerate(own):
            want.append((*r, i + 1, last))
            last = r[3]
    got = series.with_last(df, block)
    assert sorted(map(tuple, got.select("symbol", "ts", "seq", "mid", "i", "last").collect()), key=lambda r: r[2]) == sorted(want, key=lambda r: r[2])
    with_mid = df.where("symbol IS NOT NULL")
    for step in (1, 7):
        grid = {(r.symbol, r.ts): (r.i, r.mid) for r in series.locf_grid(with_mid, step).collect()}
        for symbol in (1, 2):
            own = sorted((r[1:] for r in rows if r[0] == symbol), key=lambda r: r[:2])
            points = [t for t in range(own[0][0], own[-1][0] + 1) if t % step == 0]
            carried = [next((m for ts, _, m in reversed(own) if ts <= t and m is not None), None) for t in points]
            assert [grid[symbol, t] for t in points] == [(i + 1, m) for i, m in enumerate(carried)]
            assert sum(s == symbol for s, _ in grid) == len(points)


def test_no_window_of_y17_has_a_symbols_whole_series(spark, monkeypatch):
    """Rows of one symbol are dealt to several groups for numbering and for what is before them; only the grid has a row a point."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(20_000).selectExpr("1 AS symbol", "id AS ts", "id AS seq", "id % 7 + 1.0D AS mid").repartition(4)
        parts = series.ordered(df, "ts", "seq")
        assert max(r.n for r in parts.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()) < 15_000
        lasts = series.with_last(parts, 100)
        assert max(r.n for r in lasts.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()) < 15_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_slices_start_from_what_they_name(spark):
    """Slices settle at once where their results hang on no order at a border: no more than named orders are handed on. Before, 12
    slices ran, each handed its whole book."""
    noisy = book.noisy_feed(feed(spark, SF)).where("locate <= 2")
    got, rounds = slices.replay(noisy, 100)
    want = fold.replay(noisy)
    assert rounds[-1] == 0 and sum(rounds) <= 8
    assert got.count() == want.count() and not got.select(*want.columns).exceptAll(want).count()
    # 1,000 orders rest through 10 slices, of which each names one
    rows = [(1, k, k, "A", k, None, "S", 10, 900 + k % 7) for k in range(1000)] + [(1, k, k, "X", k - 1000, None, None, 10, None) for k in range(1000, 2000)]
    df = spark.createDataFrame(rows, "locate long, seq long, us long, msg_type string, order_ref long, new_ref long, side string, shares long, price long")
    _, left, last, rounds = slices.verdicts(df, 200)
    start = slices.starts(left, last)
    assert rounds == [10, 0] and start.where("NOT best").count() == 1000 and slices.books(left, last).count() == 5000


def test_results_by_slices_of_messages_at_random(spark):
    """Every type and reject, few references that come again, and a type and references that are not there."""
    rng = random.Random(7)
    rows = []
    for k in range(3000):
        t = rng.choice("AAAAFECXDDUUUZ")
        ref, new = rng.choice([None, *range(1, 60)]), rng.choice([None, *range(1, 60)])
        price = rng.randrange(95, 104) if t in "AFU" else None
        rows.append((k % 3 + 1, k, k // 5, t, ref, new if t == "U" else None, rng.choice("BS") if t in "AF" else None, None if t == "D" else rng.randrange(0, 9), price))
    rows.append((3, 3000, 3000, "E", 10**9, None, None, None, None))  # unknown before its shares are asked for
    df = spark.createDataFrame(rows, "locate long, seq long, us long, msg_type string, order_ref long, new_ref long, side string, shares long, price long")
    packs, _, _, rounds = slices.verdicts(df, 90)
    got = {(r.locate, r.seq): (r.msg_type, r.result) for r in slices.opened(packs, ["seq", "msg_type"]).collect()}
    want = {(r.locate, r.seq): (r.msg_type, r.result) for r in fold.replay(df).collect()}
    assert rounds[0] > 30 and rounds[-1] == 0 and got == want and {r for _, r in got.values()} == set(slices.RESULTS)


def test_results_of_a_message_that_lacks_its_price(spark):
    df = spark.createDataFrame([(1, 1, 1, "A", 1, None, "B", 5, 90), (1, 2, 2, "A", 2, None, "S", 5, None)], "locate long, seq long, us long, msg_type string, order_ref long, new_ref long, side string, shares long, price long")
    packs, *_ = slices.verdicts(df, 1)
    with pytest.raises(Exception, match="lacks what its type needs"):
        slices.opened(packs, ["seq"]).collect()
