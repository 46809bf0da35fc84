"""Queries that take the messages of all hours: the session limits nothing but the gaps."""

from pyspark.sql import functions as F

from __spark_entry__ import queries
from lobspark.functions import scalars as fn
from lobspark.operators import book
from lobspark.plans.books import feed

SF = "/root/testdata/sf0.001"


def _inside(us):
    return us % fn.DAY_US * 1000 >= fn.OPEN_NS and us % fn.DAY_US * 1000 < fn.CLOSE_NS


def test_event_mids_of_all_hours(spark):
    got = {(r.locate, r.seq) for r in queries()["y02_event_mids"](spark, SF).collect()}
    both = book.replay(feed(spark, SF), depth=False, ranks=False).where("bid IS NOT NULL AND ask IS NOT NULL").collect()
    assert got == {(r.locate, r.seq) for r in both} and not all(_inside(r.us) for r in both)


def test_two_sided_fraction_of_all_hours(spark):
    two = F.col("bid").isNotNull() & F.col("ask").isNotNull()
    r = book.replay(feed(spark, SF), depth=False, ranks=False).withColumn("two", two)
    want = {x.locate: (x.a, x.s) for x in r.groupBy("locate").agg(F.round(F.avg(F.col("two").cast("double")), 6).alias("a"), F.round(F.avg(F.when(fn.in_session_us(F.col("us")), F.col("two").cast("double"))), 6).alias("s")).collect()}
    got = {x.locate: x.two_sided for x in queries()["y13_two_sided_fraction"](spark, SF).collect()}
    assert got == {k: a for k, (a, _) in want.items()} and any(a != s for a, s in want.values())


def test_event_tokens_of_all_hours(spark):
    m = feed(spark, SF).collect()
    got = {(r.symbol, r.seq): r.dt for r in queries()["t04_event_tokens"](spark, SF).collect()}
    assert set(got) == {(r.locate, r.seq) for r in m}
    outside = [got[r.locate, r.seq] for r in m if not _inside(r.us)]
    assert outside and set(outside) == {0}


def test_token_inverse_of_all_hours(spark):
    m = feed(spark, SF).collect()
    got = queries()["t15_token_inverse"](spark, SF).collect()
    assert sum(r.n for r in got) == len(m) > sum(_inside(r.us) for r in m) and not any(r.wrong for r in got)


def test_token_shares_of_all_hours(spark):
    m = feed(spark, SF).collect()
    got = queries()["t17_token_shares"](spark, SF).collect()
    assert sum(r.n for r in got) == len(m) > sum(_inside(r.us) for r in m)
