"""One average-linkage merge as joins: the relational form of a step of the kernel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import measures
from .edges import mirrored


def third_nodes(edges: DataFrame, first, second) -> DataFrame:
    """third, score1, score2: full outer join of the neighbours of two nodes that are merged."""
    seen = mirrored(edges).filter(F.col("id").isin(first, second) & ~F.col("other").isin(first, second))
    a = seen.filter(F.col("id") == first).select(F.col("other").alias("third"), F.col("score").alias("score1"))
    b = seen.filter(F.col("id") == second).select(F.col("other").alias("third"), F.col("score").alias("score2"))
    return a.join(b, "third", "full_outer")


def merged_scores(thirds: DataFrame, n1: int, n2: int, missing: float) -> DataFrame:
    mean = measures.weighted_mean(F.col("score1"), F.lit(n1), F.col("score2"), F.lit(n2), missing)
    return thirds.withColumn("merged", mean)
