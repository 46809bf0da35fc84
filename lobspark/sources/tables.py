"""Text formats of the event model as Spark tables: book snapshots, edge manifests, calibration in long form."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lobspark.functions.scalars import clock, valid_edges
from lobspark.sources.splits import allowed, split_of

#: References of orders that come from a snapshot start here.
WARM_REF = 1 << 60
#: First word of a snapshot's header line (a fixed value of the format).
MAGIC = "# oftk-warm-book v1"


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where that is unset a local session gets one; a cluster must set it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that what follows several times is computed once and survives a lost executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def safe_path(spark: SparkSession, path: str) -> str:
    """The path, if it is neither that of a day's capture nor empty: outputs must not replace inputs."""
    access = spark.range(1).select(split_of(F.lit(path)).alias("a"), F.lit(path).endswith("/").alias("d")).first()
    if not path or (access.a != "OkNotADay" and not access.d):
        raise ValueError(f"refusing to write to {path!r}")
    return path


def snapshot_lines(resting: DataFrame, day: str, ts_ns: int) -> DataFrame:
    """(locate, line_no, line): each instrument's snapshot as text: a header, the columns, then the orders in book order.

    resting: locate, side, ord, price, shares as ``book.snapshot`` gives them, bids before asks.
    """
    n = F.row_number().over(Window.partitionBy("locate").orderBy("side", "ord")) + 1
    rows = resting.select("locate", n.cast("long").alias("line_no"), F.concat_ws(",", "side", "price", "shares").alias("line"))
    heads = resting.groupBy("locate").agg(F.count("*").alias("c"))
    head = F.concat_ws(" ", F.lit(MAGIC), F.concat(F.lit("ticker="), "locate"), F.lit(f"day={day}"), F.lit(f"ts_ns={ts_ns}"), F.concat(F.lit("orders="), "c"))
    two = heads.select("locate", F.posexplode(F.array(head, F.lit("side,price,shares"))).alias("line_no", "line"))
    return rows.unionByName(two.select("locate", F.col("line_no").cast("long").alias("line_no"), "line"))


def write_snapshots(resting: DataFrame, path: str, day: str, ts_ns: int) -> None:
    """One folder for each instrument, each with one ordered text file."""
    lines = snapshot_lines(resting, day, ts_ns)
    lines.repartition(F.xxhash64("locate")).sortWithinPartitions("locate", "line_no").select("locate", "line").write.partitionBy("locate").text(safe_path(resting.sparkSession, path))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(path, ticker, day, ts_ns, ord, side, price, shares, order_ref) of snapshot files; a malformed one raises."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    lines = F.filter(F.split("value", "\n"), lambda x: x != "")
    files = files.select("path", F.element_at(lines, 1).alias("head"), F.try_element_at(lines, F.lit(2)).alias("columns"), F.posexplode_outer(F.slice(lines, 3, 2**30)).alias("ord", "line"))
    fine = F.col("head").startswith(MAGIC) & (F.coalesce("columns", F.lit("")) == "side,price,shares")
    fine = fine & (F.col("line").isNull() | F.col("line").rlike(r"^[BS],0*[1-9][0-9]{0,9},0*[1-9][0-9]{0,9}$"))
    field = lambda k: F.regexp_extract("head", rf" {k}=(\S*)", 1)
    part = F.split("line", ",")
    kept = F.when(fine, F.col("line").isNotNull()).otherwise(F.raise_error(F.concat_ws(" ", F.lit("malformed snapshot:"), "path", "line")).cast("boolean"))
    out = files.where(kept).select("path", field("ticker").alias("ticker"), field("day").alias("day"), F.coalesce(field("ts_ns").try_cast("long"), F.lit(0)).alias("ts_ns"), (F.col("ord") + 1).cast("long").alias("ord"), part[0].alias("side"), part[1].cast("long").alias("price"), part[2].cast("long").alias("shares"))
    return out.withColumn("order_ref", F.col("ord") - 1 + WARM_REF)


def warm_messages(snapshot: DataFrame) -> DataFrame:
    """A snapshot's orders as adds that come before everything else of their instrument, for ``fold.replay``."""
    return snapshot.select(F.col("ticker").cast("long").alias("locate"), (F.col("ord") - F.lit(1 << 40)).alias("seq"), F.lit(-1).cast("long").alias("us"), F.lit("A").alias("msg_type"), "order_ref", F.lit(None).cast("bigint").alias("new_ref"), "side", "shares", "price")


MANIFEST = "ticker string, tick_size long, size_edges array<long>, dt_edges_ns array<long>, fit struct<messages_file:string,train_frac:double,rows_total:long>"


def write_manifest(edges: DataFrame, path: str) -> None:
    """Tickers' edges with their provenance as JSON lines (columns of ``MANIFEST``)."""
    edges.select("ticker", "tick_size", "size_edges", "dt_edges_ns", "fit").orderBy("ticker").coalesce(1).write.json(safe_path(edges.sparkSession, path))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Edges by ticker; unparsable lines, edges that don't rise and tick sizes below one raise."""
    m = spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(path)
    fine = valid_edges(F.col("size_edges")) & valid_edges(F.col("dt_edges_ns")) & (F.col("tick_size") > 0)
    return m.withColumn("ticker", F.when(fine, F.col("ticker")).otherwise(F.raise_error(F.concat(F.lit("bad edges: "), F.coalesce("ticker", F.lit("?"))))))


LONG_FORM = "kind string, symbol string, side string, key long, a double, b double, c double"


def calibration_rows(adds: DataFrame, cancels: DataFrame, exposure: DataFrame, sizes: DataFrame) -> DataFrame:
    """The long form (``LONG_FORM``): flow rows with adds, cancels and exposure by distance, noref rows with
    what has no distance, and size histograms."""
    parts = [df.select("locate", "side", "d", *(F.col(own).cast("double").alias(c) if c == name else F.lit(0.0).alias(c) for c in "abc")) for df, own, name in ((adds, "n", "a"), (cancels, "n", "b"), (exposure, "order_seconds", "c"))]
    flow = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("locate", "side", "d").agg(*(F.sum(c).alias(c) for c in "abc"))
    apart = F.col("d").isNull()  # messages that had no opposite best to be measured from
    flow = flow.select(F.when(apart, "noref").otherwise("flow").alias("kind"), F.col("locate").cast("string").alias("symbol"), "side", F.coalesce("d", F.lit(0)).alias("key"), "a", "b", "c")
    zero = F.lit(0.0)
    size = sizes.select(F.concat("kind", F.lit("sz")).alias("kind"), F.col("symbol").cast("string").alias("symbol"), F.lit("-").alias("side"), F.col("shares").alias("key"), F.col("n").cast("double").alias("a"), zero.alias("b"), zero.alias("c"))
    return flow.unionByName(size)


def read_calibration(spark: SparkSession, paths: list[str], allow_test: bool = False) -> DataFrame:
    """Calibrations of several days (CSV with a header), merged by addition."""
    rows = spark.read.schema(LONG_FORM).option("header", True).option("mode", "FAILFAST").csv(paths)
    rows = rows.withColumn("path", F.input_file_name()).where(allowed(split_of(F.col("path")), allow_test) | F.raise_error(F.lit("refused by the split guard")).isNotNull())
    return rows.groupBy("kind", "symbol", "side", "key").agg(*(F.sum(c).alias(c) for c in "abc"))


#: Columns of the CSV outputs, in order (fixed values): a symbol's event series, its grid, the curves, the touch trace,
#: and histograms.
LAYOUTS = {
    "event": ("ts_ns", "mid"),
    "1s": ("t_s", "mid"),
    "acf": ("lag", "acf_r_event", "acf_absr_event", "acf_r_1s", "acf_absr_1s", "acf_absr_tick"),
    "flowacf": ("lag", "acf_sign"),
    "bbo": ("time", "bid", "ask", "spread", "bid_depth", "ask_depth"),
    "histogram": ("value", "count"),
}


def write_csv(df: DataFrame, path: str, layout: str, by: str = "symbol") -> None:
    """A CSV with a header in a folder for each value of ``by``, with the columns of a layout in its order.

    Spark's writer commits the files, so any store will do and a retried task leaves nothing behind. The rows of a
    folder are sorted by the first column within its files.
    """
    columns = LAYOUTS[layout]
    df.select(by, *columns).repartition(by).sortWithinPartitions(by, columns[0]).write.partitionBy(by).option("header", True).csv(safe_path(df.sparkSession, path))


def touch_trace(touch: DataFrame) -> DataFrame:
    """(symbol, and the layout "bbo") of sampled touches (locate, t in microseconds, bid, bid_shares, ask, ask_shares):
    prices in dollars; 0 for an empty side, and for the spread where one is."""
    money = lambda c: F.format_string("%.4f", c)
    bid, ask = (F.coalesce(F.col(c), F.lit(0)) / 10000.0 for c in ("bid", "ask"))
    spread = F.when(F.col("bid").isNotNull() & F.col("ask").isNotNull(), ask - bid).otherwise(0.0)
    none = F.lit(0).cast("long")
    return touch.select(F.col("locate").alias("symbol"), clock(F.col("t") % 86_400_000_000 * 1000).alias("time"), money(bid).alias("bid"), money(ask).alias("ask"), money(spread).alias("spread"), F.coalesce("bid_shares", none).alias("bid_depth"), F.coalesce("ask_shares", none).alias("ask_depth"))
