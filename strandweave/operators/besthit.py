"""Best-hit tests between species pairs, and reciprocal best hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_best(hits: DataFrame) -> DataFrame:
    """hits with species1, species2: adds best1 and best2, each end's best score in the other's species.

    Both bests come from one aggregation by (gene, species) over the mirrored hits,
    partial before its shuffle; no window sorts a gene's hits.
    """
    seen = hits.select(F.col("id1").alias("g"), F.col("species2").alias("s"), "score").union(hits.select(F.col("id2").alias("g"), F.col("species1").alias("s"), "score"))
    best = seen.groupBy("g", "s").agg(F.max("score").alias("best"))
    one = best.select(F.col("g").alias("id1"), F.col("s").alias("species2"), F.col("best").alias("best1"))
    two = best.select(F.col("g").alias("id2"), F.col("s").alias("species1"), F.col("best").alias("best2"))
    return hits.join(one, ["id1", "species2"]).join(two, ["id2", "species1"])


def near_best(hits: DataFrame, percent: float, ends: str) -> DataFrame:
    """Hits whose score is at least ``percent`` of the best of both ends, or of any."""
    a = (F.col("score") + 0.1) * 100 / (F.col("best1") + 0.1) >= F.lit(float(percent))
    b = (F.col("score") + 0.1) * 100 / (F.col("best2") + 0.1) >= F.lit(float(percent))
    return with_best(hits).filter(a & b if ends == "both" else a | b)


def reciprocal(hits: DataFrame) -> DataFrame:
    return with_best(hits).filter((F.col("score") == F.col("best1")) & (F.col("score") == F.col("best2")) & (F.col("species1") != F.col("species2")))
