"""Clusters and trees as text, tables, graphs and HTML.

Members are rows (cluster, species, gene, dom, from, to); every text is made by Column
expressions per row or group and written by Spark, one line a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _name(numbered: bool | Column) -> Column:
    plain = F.concat_ws(":", "species", "gene")
    return F.when(numbered if isinstance(numbered, Column) else F.lit(numbered), F.concat(plain, F.lit("("), F.col("dom").cast("string"), F.lit(")"))).otherwise(plain)


def blocks(members: DataFrame) -> DataFrame:
    """(cluster, value): a block per cluster, ``Cluster n``, members, blank line; a number only where a gene has several domains."""
    split = members.groupBy("species", "gene").agg((F.max("dom") > 1).alias("several"))
    line = F.concat_ws(" ", _name(F.col("several")), F.col("from").cast("string"), F.col("to").cast("string"))
    rows = members.join(split, ["species", "gene"]).withColumn("line", line)
    listed = F.array_sort(F.collect_list(F.struct("species", "gene", "dom", "line")))
    return rows.groupBy("cluster").agg(listed.alias("m")).select("cluster", F.concat(F.lit("Cluster "), F.col("cluster").cast("string"), F.lit("\n"), F.array_join("m.line", "\n"), F.lit("\n")).alias("value"))


def flat(members: DataFrame) -> DataFrame:
    """(value): cluster, gene, domain, from, to in a line."""
    return members.select(F.concat_ws(" ", F.col("cluster").cast("string"), F.concat_ws(":", "species", "gene"), *[F.col(c).cast("string") for c in ("dom", "from", "to")]).alias("value"))


def table(members: DataFrame, species: list[str]) -> DataFrame:
    """One row a cluster, one column a species: its members, joined by spaces."""
    split = members.groupBy("species", "gene").agg((F.max("dom") > 1).alias("several"))
    rows = members.join(split, ["species", "gene"]).withColumn("name", _name(F.col("several")))
    return rows.groupBy("cluster").pivot("species", species).agg(F.array_join(F.array_sort(F.collect_list("name")), " ")).na.fill("")


def graph(tree: DataFrame) -> DataFrame:
    """(value): parent and child in a line."""
    return tree.filter("parent_id is not null").select(F.concat_ws(" ", F.col("parent_id").cast("string"), F.col("node_id").cast("string")).alias("value"))


def dot(tree: DataFrame) -> DataFrame:
    """(cluster_id, value): each tree as a GraphViz graph."""
    edge = F.concat(F.lit("  n"), F.col("parent_id").cast("string"), F.lit(" -> n"), F.col("node_id").cast("string"), F.lit(";"))
    node = F.concat(F.lit("  n"), F.col("node_id").cast("string"), F.lit(' [label="'), F.coalesce("gene", F.format_string("%.1f", "score")), F.lit('"];'))
    lines = tree.select("component", "cluster_id", "node_id", F.concat_ws("\n", node, F.when(F.col("parent_id").isNotNull(), edge)).alias("l"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "l"))), lambda x: x["l"]), "\n")
    return lines.groupBy("component", "cluster_id").agg(F.concat(F.lit("digraph {\n"), body, F.lit("\n}")).alias("value"))


def html(wide: DataFrame) -> DataFrame:
    """(value): a table row for each row of ``table``."""
    def safe(c: Column) -> Column:
        return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    cells = F.concat(*[F.concat(F.lit("<td>"), safe(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))), F.lit("</td>")) for c in wide.columns])
    return wide.select(F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("value"))


def scores(tree: DataFrame) -> DataFrame:
    """(component, cluster_id, score, dist) of the roots."""
    return tree.filter("parent_id is null").select("component", "cluster_id", "score", "dist")


def write_text(lines: DataFrame, path: str) -> None:
    lines.select("value").write.text(path)
