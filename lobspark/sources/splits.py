"""Which days may be read: a guard over file names that keeps test days out of training jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days by split (fixed values).
SPLITS = {
    "train": ["20190130", "20190327", "20190530", "20190830", "20191030", "20191230"],
    "validation": ["20190730"],
    "test": ["20181228", "20200130"],
}


def split_of(path: Column, splits: dict[str, list[str]] = SPLITS) -> Column:
    """OkTrain, OkVal, TestBlocked, UnknownDay or OkNotADay, by the run of exactly eight digits in the file's name.

    The files of a table that Spark wrote have random names; there the table's own name counts.
    """
    parts = F.split(F.regexp_replace(path, "/part-[^/]*$", ""), "/")
    name = F.element_at(parts, -1)
    day = F.regexp_extract(name, r"(?:^|[^0-9])([0-9]{8})(?:[^0-9]|$)", 1)
    return (
        F.when(day == "", "OkNotADay")
        .when(day.isin(splits["train"]), "OkTrain")
        .when(day.isin(splits["validation"]), "OkVal")
        .when(day.isin(splits["test"]), "TestBlocked")
        .otherwise("UnknownDay")
    )


def allowed(access: Column, allow_test: bool = False) -> Column:
    """Asking for it opens test days, never unknown ones."""
    return access.isin("OkTrain", "OkVal", "OkNotADay", *(["TestBlocked"] if allow_test else []))


def guarded(files: DataFrame, allow_test: bool = False) -> DataFrame:
    """``files`` unchanged; reading a row of a path that isn't allowed raises."""
    access = split_of(F.col("path"))
    return files.withColumn("path", F.when(allowed(access, allow_test), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("refused by the split guard: "), "path"))))
