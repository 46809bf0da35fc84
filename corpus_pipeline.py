"""From raw documents to packed training sequences: five corpus operators, one after the other.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is written and read
again before the next one starts. All but the last return the columns of ``documents``. A table without rows gives an
empty result at every stage, and further columns are carried along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lobspark.llm import decontaminate, packing, pii, quality, simhash, tokens
from lobspark.llm.common import checkpointed, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the classifier scores 0.5 or more."""
    model = quality.learned(docs, table(spark, sf_dir, "labels"))
    name = "score"
    while name in docs.columns:
        name += "_"
    return quality.scored(docs, model, name).where(F.col(name) >= 0.5).select(*docs.columns)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of each row, stored so that it never changes, and the name of that column."""
    name = "row"
    while name in docs.columns:
        name += "_"
    return stored(docs.withColumn(name, F.monotonically_increasing_id())), name


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near-duplicates, the one with the smallest doc_id.

    A document without doc_id stays only where its whole component has none. Among rows that share the smallest doc_id
    (or have none), a hash of the columns decides.
    """
    rows, key = keyed(docs)
    tie = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])  # what Spark can hash
    keep = simhash.representatives(rows.select("doc_id", "text", tie.alias("tie"), F.col(key).alias("row")))
    return rows.join(keep.withColumnRenamed("row", key), key, "left_semi").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words a twentieth or more stands in benchmark windows."""
    rows, key = keyed(docs)
    spans = decontaminate.contaminated_spans(rows, table(spark, sf_dir, "benchmark"), row=key)
    bad = checkpointed(decontaminate.report(spans).where("contaminated").select(key))
    return rows.join(bad, key, "left_anti").select(*docs.columns)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the new text."""
    out = pii.masked(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' ids into sequences of at most 2048."""
    return packing.pack(tokens.pieces(docs))


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", personal_data_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can express neither the classifier nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
