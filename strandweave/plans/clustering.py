"""Queries of the clustering kernel; they have no SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster, groups
from ..operators.edges import edges_of
from ..params import Params
from ..sources import bridge
from ..storage import materialize

#: Words instead of residues: lengths are those of documents.
PARAMS = Params(cutoff=6.0, miss_score=3.0, min_len=20, min_len2=120, min_overlap=15, min_species=1, skip_unknown=True)
_kept: dict = {}


def linked(spark: SparkSession, d: str, params: Params = PARAMS) -> DataFrame:
    key = (spark.sparkContext.applicationId, d, params)
    if key not in _kept:
        genes, hits = bridge.kept(spark, d)
        _kept[key] = materialize(cluster.link(genes, edges_of(hits, genes, params, list(params.outgroup)), params), "linked")
    return _kept[key]


def domain_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Flat members of every cluster, numbered from the largest."""
    rows = cluster.cut(linked(spark, d), PARAMS, "domains")
    rows = materialize(rows, "domains")
    sizes = rows.groupBy("component", "cluster_id").agg(F.count(F.lit(1)).alias("members"), F.min("gene").alias("least"))
    order = groups.numbered(sizes, "cluster", F.desc("members"), F.asc("least"), F.asc("component"), F.asc("cluster_id"))
    return rows.join(order, ["component", "cluster_id"]).select("cluster", "species", "gene", "dom", "from", "to")


def domain_regions(spark: SparkSession, d: str) -> DataFrame:
    """Genes that were split, with their segments in order."""
    rows = cluster.cut(linked(spark, d), PARAMS, "domains")
    parts = rows.groupBy("species", "gene").agg(F.array_sort(F.collect_list(F.struct("dom", "from", "to"))).alias("parts"))
    return parts.filter(F.size("parts") > 1)


def cluster_tree(spark: SparkSession, d: str) -> DataFrame:
    return cluster.cut(linked(spark, d), PARAMS, "tree")


def newick(spark: SparkSession, d: str) -> DataFrame:
    return cluster.cut(linked(spark, d), PARAMS, "newick")


def parent_child(spark: SparkSession, d: str) -> DataFrame:
    """Edges of all trees."""
    t = cluster.cut(linked(spark, d), PARAMS, "tree")
    return t.filter("parent_id is not null").select("component", F.col("parent_id").alias("parent"), F.col("node_id").alias("child"))


def phylo_cut(spark: SparkSession, d: str) -> DataFrame:
    """The same merges cut at a lower share of common species: the table between the phases is used again."""
    strict = Params(**{**PARAMS.__dict__, "cut_ratio": 0.1})
    return cluster.cut(linked(spark, d), strict, "domains")


def homology_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Uncut trees."""
    return cluster.cut(linked(spark, d), Params(**{**PARAMS.__dict__, "homology": True}), "domains")


def average_linkage(spark: SparkSession, d: str) -> DataFrame:
    """Classic average linkage: genes stay whole."""
    whole = Params(**{**PARAMS.__dict__, "no_break": True})
    return cluster.cut(linked(spark, d, whole), whole, "domains")


QUERIES = {f.__name__: f for f in (domain_cluster, domain_regions, cluster_tree, newick, parent_child, phylo_cut, homology_cluster, average_linkage)}
