"""From hits to edges: admission, filters, corrections and one edge a pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures, regions
from ..params import Params


def admit(hits: DataFrame, params: Params) -> DataFrame:
    """Drops hits beyond the missing value (not beyond the cutoff)."""
    p = params.resolved()
    return hits.filter(F.col("score") >= F.lit(p.miss_score)) if p.by_score else hits.filter(F.col("dist") <= F.lit(p.miss_dist))


def with_lengths(hits: DataFrame, genes: DataFrame) -> DataFrame:
    """Adds species and length of both genes; hits of unknown genes go."""
    a = genes.select(F.col("gene").alias("id1"), F.col("species").alias("species1"), F.col("length").alias("length1"))
    b = genes.select(F.col("gene").alias("id2"), F.col("species").alias("species2"), F.col("length").alias("length2"))
    return hits.join(a, "id1").join(b, "id2")


def unknown(hits: DataFrame, genes: DataFrame) -> DataFrame:
    """Hits with an end that is not a gene."""
    left = hits.join(genes.select(F.col("gene").alias("id1")), "id1", "left_anti")
    right = hits.join(genes.select(F.col("gene").alias("id1")), "id1", "left_semi").join(genes.select(F.col("gene").alias("id2")), "id2", "left_anti")
    return left.unionByName(right)


def covered(hits: DataFrame, share: float) -> DataFrame:
    """Hits (with lengths) whose alignment covers a share of the shorter gene."""
    a, b = regions.length(F.col("from1"), F.col("to1")), regions.length(F.col("from2"), F.col("to2"))
    ratio = measures.coverage_of_shorter(F.col("length1"), F.col("length2"), a, b)
    return hits.withColumn("coverage", ratio).filter(F.col("coverage") >= F.lit(share))


def canonical(hits: DataFrame) -> DataFrame:
    """The smaller id first, its region with it; of a self-hit, the region that starts first; self-hits of one region go."""
    same = F.col("id1") == F.col("id2")
    turn = (F.col("id1") > F.col("id2")) | same & (F.col("from1") > F.col("from2"))
    out = hits.filter(~(same & (F.col("from1") == F.col("from2")) & (F.col("to1") == F.col("to2"))))
    pairs = [("id1", "id2"), ("from1", "from2"), ("to1", "to2")]
    swapped = {a: F.when(turn, F.col(b)).otherwise(F.col(a)) for a, b in pairs} | {b: F.when(turn, F.col(a)).otherwise(F.col(b)) for a, b in pairs}
    return out.select(*[swapped.get(c, F.col(c)).alias(c) for c in out.columns])


def best_of_pair(edges: DataFrame, keys: list[str], *ties: str) -> DataFrame:
    """The edge of the highest score of each pair; ties by the columns given.  A max of structs: partial before the shuffle, no sort."""
    rest = [c for c in edges.columns if c not in keys and c != "score" and c not in ties]
    order = F.struct("score", *[(-F.col(t)).alias(f"neg_{t}") for t in ties], *ties, *rest)
    return edges.groupBy(*keys).agg(F.max(order).alias("best")).select(*keys, "best.score", *[f"best.{c}" for c in (*ties, *rest)])


def either(hits: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Hits with at least one end in a list of names."""
    marked = names.select(F.col(column).alias("n")).distinct().withColumn("listed", F.lit(True))
    out = hits.join(marked.withColumnRenamed("n", "id1").withColumnRenamed("listed", "in1"), "id1", "left").join(marked.withColumnRenamed("n", "id2").withColumnRenamed("listed", "in2"), "id2", "left")
    return out.filter(F.coalesce("in1", "in2", F.lit(False))).drop("in1", "in2")


def both(hits: DataFrame, names: DataFrame, column: str) -> DataFrame:
    listed = names.select(F.col(column).alias("n")).distinct()
    return hits.join(listed.withColumnRenamed("n", "id1"), "id1", "left_semi").join(listed.withColumnRenamed("n", "id2"), "id2", "left_semi")


def of_clusters(hits: DataFrame, members: DataFrame, clusters: list | None = None, genes: list | None = None, whole: bool = True) -> DataFrame:
    """Hits of the genes of some clusters: members (gene, label), clusters by label or by a gene that they hold; both ends in one, or with ``whole`` unset any end."""
    wanted = F.lit(False)
    if clusters:
        wanted = wanted | F.col("label").isin(clusters)
    if genes:
        held = members.filter(F.col("gene").isin(genes)).select(F.col("label").alias("sw_label")).distinct()
        members = members.join(held, members.label == held.sw_label, "left")
        wanted = wanted | F.col("sw_label").isNotNull()
    kept = members.filter(wanted).select("gene", "label").distinct()
    if not whole:
        return either(hits, kept, "gene")
    a, b = kept.select(F.col("gene").alias("id1"), F.col("label").alias("sw_a")), kept.select(F.col("gene").alias("id2"), F.col("label").alias("sw_b"))
    return hits.join(a, "id1").join(b, "id2").filter("sw_a = sw_b").drop("sw_a", "sw_b").distinct()


def mirrored(hits: DataFrame) -> DataFrame:
    """Each hit seen from either end: id, other, from, to, other_from, other_to, score."""
    one = hits.select(F.col("id1").alias("id"), F.col("id2").alias("other"), F.col("from1").alias("from"), F.col("to1").alias("to"), F.col("from2").alias("other_from"), F.col("to2").alias("other_to"), "score")
    two = hits.select(F.col("id2").alias("id"), F.col("id1").alias("other"), F.col("from2").alias("from"), F.col("to2").alias("to"), F.col("from1").alias("other_from"), F.col("to1").alias("other_to"), "score")
    return one.unionByName(two)


class UnknownGenes(ValueError):
    """Hits name genes that are not in the gene table."""


def edges_of(hits: DataFrame, genes: DataFrame, params: Params, outgroup: list[str] | None = None) -> DataFrame:
    """Hits to the edges that clustering starts from: all of the above in the order of the reference's ingest.

    outgroup: its species; a hit across its border counts a step less in ties, one within a species a step more.
    Hits of unknown genes are left out with ``skip_unknown``, and refused without.
    """
    p = params.resolved()
    admitted = admit(hits, p)
    if not p.skip_unknown and (first := unknown(admitted, genes).select("id1", "id2").first()) is not None:
        raise UnknownGenes(f"a hit of {first.id1} and {first.id2} names a gene that is not known; skip_unknown leaves such hits out")
    out = with_lengths(admitted, genes)
    if p.cov_filter:
        out = covered(out, p.cov_filter).drop("coverage")
    if not p.by_score and p.min_alignment:
        aligned = F.least(regions.length(F.col("from1"), F.col("to1")), regions.length(F.col("from2"), F.col("to2")))
        out = out.withColumn("dist", measures.short_alignment_penalty(F.col("dist").cast("double"), aligned, F.least("length1", "length2"), p.miss_dist, p.min_alignment))
    out = canonical(out.filter(F.col("id1") != F.col("id2")))
    same = F.col("species1") == F.col("species2")
    across = F.col("species1").isin(outgroup) != F.col("species2").isin(outgroup) if outgroup else F.lit(False)
    out = out.withColumn("score", measures.tie_correction(F.col("score").cast("double"), same, across, p.dist_scale))
    return best_of_pair(out, ["id1", "id2"], "from1", "from2")


def connections(edges: DataFrame, first, second, most: int = 65_535) -> DataFrame:
    """third, links, score_sum of the node that two merged nodes make: edges (id1, id2, score, links) as ``merging.third_nodes`` sees them; links stop at ``most``."""
    seen = mirrored(edges.withColumn("from1", F.col("links")).withColumn("to1", F.lit(0)).withColumn("from2", F.col("links")).withColumn("to2", F.lit(0)))
    near = seen.filter(F.col("id").isin(first, second) & ~F.col("other").isin(first, second))
    return near.groupBy(F.col("other").alias("third")).agg(F.least(F.sum("from"), F.lit(most)).cast("int").alias("links"), F.sum("score").alias("score_sum"))


def rank_within(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
