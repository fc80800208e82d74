"""Interval joins by bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, key: str, least: int, width: int = 256) -> DataFrame:
    """Pairs of one key whose closed intervals (lf, lt) and (rf, rt) share at least ``least`` positions.

    Both sides are put into bins of ``width`` positions, joined on (key, bin), and kept only in
    the bin where the overlap starts, so that no pair appears twice and none is sorted out later.
    """
    a = left.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lf") / width), F.floor(F.col("lt") / width))))
    b = right.withColumn("bin", F.explode(F.sequence(F.floor(F.col("rf") / width), F.floor(F.col("rt") / width))))
    shared = F.least("lt", "rt") - F.greatest("lf", "rf") + 1
    first = F.floor(F.greatest("lf", "rf") / width) == F.col("bin")
    return a.join(b, [key, "bin"]).filter(first & (shared >= least)).drop("bin")
