"""Species trees as tables: node profiles, ancestors, least common taxon."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def closure(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """node, ancestor, depth of a table (node, parent), by a recursive query; a node is its own ancestor at 0."""
    nodes.createOrReplaceTempView("sw_tree")
    return spark.sql("""
        WITH RECURSIVE up(node, ancestor, depth) AS (
          SELECT node, node, 0 FROM sw_tree
          UNION ALL SELECT u.node, t.parent, u.depth + 1 FROM up u JOIN sw_tree t ON u.ancestor = t.node WHERE t.parent IS NOT NULL)
        SELECT node, ancestor, depth FROM up""")


#: Nodes of a species tree, at most; it is looked through on the driver and sent along with expressions.
MOST_NODES = 20_000


def least_taxon(rows: DataFrame, tree: DataFrame, profile: str) -> DataFrame:
    """Adds taxon: the deepest node whose profile holds the row's, null if none does.  Every row keeps its own.

    tree: node_id ascending from the root, depth, profile.  It is a species tree, of some thousand
    nodes at most, which is asserted.  Each different profile is looked up once, then joined back.
    """
    if tree.count() > MOST_NODES:
        raise ValueError(f"a species tree of more than {MOST_NODES:,} nodes")
    t = F.broadcast(tree.select("node_id", "depth", F.col("profile").alias("node_profile")))
    known = rows.select(F.col(profile).alias("sw_p")).distinct()
    found = known.join(t, F.col("sw_p").bitwiseAND(F.col("node_profile")) == F.col("sw_p")).groupBy("sw_p").agg(F.max(F.struct("depth", "node_id")).alias("m"))
    return rows.join(found.select("sw_p", F.col("m.node_id").alias("taxon")), rows[profile].eqNullSafe(F.col("sw_p")), "left").drop("sw_p")


def labels(tree: DataFrame) -> DataFrame:
    """node_id, name of a tree (node_id, parent_id, label, species): its label, else its species; a leaf without a label that is its
    parent's only child takes the parent's."""
    up = tree.groupBy(F.col("parent_id").alias("up")).agg(F.count(F.lit(1)).alias("kin"))
    parents = tree.select(F.col("node_id").alias("up"), F.col("label").alias("up_label")).join(up, "up")
    own = F.when(F.col("species").isNotNull() & F.col("label").isNull() & (F.col("kin") == 1), F.col("up_label"))
    return tree.join(parents, tree.parent_id == parents.up, "left").select("node_id", F.coalesce(own, "label", "species").alias("name"))


def subtree_counts(rows: DataFrame, tree: DataFrame, profile: str) -> DataFrame:
    """Adds subtrees: how many subtrees of a species tree a row's profile is made of, each as large as it can be.

    tree: node_id, parent_id, profile; as in ``least_taxon``, each different profile is looked up once.
    """
    if tree.count() > MOST_NODES:
        raise ValueError(f"a species tree of more than {MOST_NODES:,} nodes")
    up = tree.select(F.col("node_id").alias("up"), F.col("profile").alias("up_profile"))
    t = F.broadcast(tree.join(up, tree.parent_id == up.up, "left").select(F.col("profile").alias("node_profile"), "up_profile"))
    p = F.col("sw_p")
    whole = lambda c: c.bitwiseAND(p) == c
    known = rows.select(F.col(profile).alias("sw_p")).distinct()
    largest = whole(F.col("node_profile")) & ~F.coalesce(whole(F.col("up_profile")), F.lit(False))
    found = known.join(t, largest).groupBy("sw_p").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(found, rows[profile].eqNullSafe(F.col("sw_p")), "left").withColumn("subtrees", F.coalesce("n", F.lit(0))).drop("sw_p", "n")
