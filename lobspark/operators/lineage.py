"""Orders across replaces: each order's first ancestor and how many replaces lie between, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobspark.sources.tables import checkpointed


def roots(edges: DataFrame) -> DataFrame:
    """(locate, ref, root, hops) for each replaced-by edge (locate, old, new); a ref that is no edge's new is its own root.

    Each ref is the new one of at most one edge; edges in a circle raise. After k rounds a ref points 2**k edges back or at its
    root, so a chain of n takes log2(n) rounds. A ref that has reached its root only stands to be looked up, and of the
    others no two point at the same one: no key gathers rows.
    """
    known = checkpointed(edges.select("locate", F.col("new").alias("ref"), F.col("old").alias("root"), F.lit(1).cast("long").alias("hops"), F.lit(False).alias("done")))
    left, rounds = known.count(), 0
    most = left
    while left:
        if rounds > most.bit_length() + 1:
            raise ValueError("replaces in a circle")
        further = known.select("locate", F.col("ref").alias("root"), F.col("root").alias("_root"), F.col("hops").alias("_hops"))
        step = known.where("NOT done").join(further, ["locate", "root"], "left")
        step = step.select("locate", "ref", F.coalesce("_root", "root").alias("root"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), F.col("_root").isNull().alias("done"))
        known = checkpointed(known.where("done").unionByName(step))
        left, rounds = known.where("NOT done").count(), rounds + 1
    return known.drop("done")


def histories(messages: DataFrame) -> DataFrame:
    """(locate, root, hops, seq, msg_type, order_ref, new_ref): each message under the first order of its chain of replaces.

    messages: accepted ones. A U stands at its old order; hops counts the replaces before that order.
    """
    edges = messages.where("msg_type = 'U'").select("locate", F.col("order_ref").alias("old"), F.col("new_ref").alias("new"))
    found = roots(edges).withColumnRenamed("ref", "order_ref")
    out = messages.join(found, ["locate", "order_ref"], "left")
    return out.select("locate", F.coalesce("root", "order_ref").alias("root"), F.coalesce("hops", F.lit(0).cast("long")).alias("hops"), "us", "seq", "msg_type", "order_ref", "new_ref")
