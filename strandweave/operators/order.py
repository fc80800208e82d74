"""Order of genes on their genomes and runs in sorted tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbors(genes: DataFrame, by: Column, circular: bool = False) -> DataFrame:
    """species, gene, next: adjacent genes of a species; on a circle the last one meets the first."""
    w = Window.partitionBy("species").orderBy(by)
    following = F.lead("gene").over(w)
    if circular:
        first = F.first("gene").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        following = F.coalesce(following, first)
    out = genes.select("species", "gene", following.alias("next"))
    return out.filter(F.col("next").isNotNull() & (F.col("next") != F.col("gene")))


def islands(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """key, island, value, first, last, n: runs of equal values in order within a key (``order``[0] is reported)."""
    w = Window.partitionBy(key).orderBy(*order)
    start = F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(1))
    numbered = rows.withColumn("start", start).withColumn("island", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "island", value).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count(F.lit(1)).alias("n"))


def support(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """left, right, cnt: adjacent genes counted by the groups that they are in.  groups: id, label."""
    a = groups.select(F.col("id").alias("gene"), F.col("label").alias("left"))
    b = groups.select(F.col("id").alias("next"), F.col("label").alias("right"))
    return pairs.join(a, "gene").join(b, "next").filter(F.col("left") != F.col("right")).groupBy("left", "right").agg(F.count(F.lit(1)).alias("cnt"))
