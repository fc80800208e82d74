"""Groups of genes: sizes, ranks, tables, and the comparison of two groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize


def members(labels: DataFrame, genes: DataFrame) -> DataFrame:
    """label, gene, species, length."""
    return labels.select(F.col("id").alias("gene"), "label").join(genes, "gene").select("label", "gene", "species", "length")


def sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("members"), F.countDistinct("species").alias("species"))


def large(rows: DataFrame, min_species: int, min_members: int) -> DataFrame:
    s = sizes(rows)
    return s.filter((F.col("species") >= min_species) & (F.col("members") >= min_members))


def numbered(rows: DataFrame, name: str, *order) -> DataFrame:
    """Adds numbers from 1 in an order, in which no two rows are equal.

    Rows are dealt by ranges of the order, counted by range and numbered within; no task sees more than a range.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The n-th row of a partition has n as the low bits of this id, the partition's number as the high ones.
    held = materialize(dealt.withColumn("sw_id", F.monotonically_increasing_id()), "numbered")
    part, at = F.shiftright("sw_id", 33), F.col("sw_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = held.groupBy(part.alias("sw_part")).agg(F.count(F.lit(1)).alias("sw_n"))
    past = Window.orderBy("sw_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    starts = counts.select("sw_part", F.coalesce(F.sum("sw_n").over(past), F.lit(0)).alias("sw_start"))
    return held.withColumn("sw_part", part).join(F.broadcast(starts), "sw_part").withColumn(name, (F.col("sw_start") + at + 1).cast("int")).drop("sw_part", "sw_id", "sw_start")


def ranked(groups: DataFrame) -> DataFrame:
    """cluster_id from 1, larger groups first, ties to the smaller label."""
    return numbered(groups, "cluster_id", F.desc("members"), F.asc("label"))


def species_table(rows: DataFrame, species: list[str]) -> DataFrame:
    """One row a group, one column a species: its genes in order, joined by spaces."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list("gene")), lambda g: g.cast("string")), " ")
    return rows.groupBy("label").pivot("species", species).agg(text)


def best_match(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """label, best, common, jaccard: for each group of ``ours`` the group of ``theirs`` (gene, label) closest by Jaccard."""
    n1 = ours.groupBy("label").agg(F.count(F.lit(1)).alias("n1"))
    n2 = theirs.groupBy(F.col("label").alias("other")).agg(F.count(F.lit(1)).alias("n2"))
    met = ours.select("gene", "label").join(theirs.select("gene", F.col("label").alias("other")), "gene").groupBy("label", "other").agg(F.count(F.lit(1)).alias("common"))
    all_ = met.join(n1, "label").join(n2, "other")
    j = F.col("common") / (F.col("n1") + F.col("n2") - F.col("common"))
    best = all_.withColumn("jaccard", j).groupBy("label").agg(F.max(F.struct("jaccard", (-F.col("other")).alias("neg"), "other", "common", "n1", "n2")).alias("b"))
    return best.select("label", F.col("b.other").alias("best"), "b.common", "b.jaccard", "b.n1", "b.n2")


def marks(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """label, tp, fp, fn against the best match."""
    m = best_match(ours, theirs)
    return m.select("label", F.col("common").alias("tp"), (F.col("n2") - F.col("common")).alias("fp"), (F.col("n1") - F.col("common")).alias("fn"))


def mean_length(domains: DataFrame, *keys: str) -> DataFrame:
    """keys, mean_length: the whole part of the mean length of a cluster's domains (from, to)."""
    return domains.groupBy(*keys).agg(F.sum((F.col("to") - F.col("from") + 1).cast("long")).alias("n"), F.count(F.lit(1)).alias("k")).select(*keys, F.expr("n div k").alias("mean_length"))


def best_match_domains(ours: DataFrame, theirs: DataFrame, of_shorter: float = 0.5) -> DataFrame:
    """label, best, common, jaccard as ``best_match``, where a domain counts as common if one of the same gene in the other group overlaps it.

    ours, theirs: (gene, label, from, to).  Two domains overlap if they share more than ``of_shorter`` of the shorter.
    """
    n1 = ours.groupBy("label").agg(F.count(F.lit(1)).alias("n1"))
    n2 = theirs.groupBy(F.col("label").alias("other")).agg(F.count(F.lit(1)).alias("n2"))
    a = ours.select("gene", "label", F.col("from").alias("af"), F.col("to").alias("at"))
    b = theirs.select("gene", F.col("label").alias("other"), F.col("from").alias("bf"), F.col("to").alias("bt"))
    shared = F.least("at", "bt") - F.greatest("af", "bf")
    short = F.least(F.col("at") - F.col("af"), F.col("bt") - F.col("bf")) + 1
    met = a.join(b, "gene").filter(shared > short * F.lit(of_shorter)).select("label", "other", "gene", "af", "at").distinct()
    met = met.groupBy("label", "other").agg(F.count(F.lit(1)).alias("common"))
    j = F.col("common") / (F.col("n1") + F.col("n2") - F.col("common"))
    best = met.join(n1, "label").join(n2, "other").withColumn("jaccard", j).groupBy("label").agg(F.max(F.struct("jaccard", (-F.col("other")).alias("neg"), "other", "common")).alias("b"))
    return best.select("label", F.col("b.other").alias("best"), "b.common", "b.jaccard")


def cross_named(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows (gene, ...) under the other names of their genes: names (gene, name), several of a gene give a row each; others keep their own."""
    return rows.join(names.select("gene", F.col("name").alias("sw_name")), "gene", "left").withColumn("gene", F.coalesce("sw_name", "gene")).drop("sw_name")
