"""Domain-splitting clustering of a whole graph: components, then one kernel call a component.

No state of the agglomeration crosses components of the admitted edges, so the kernel runs
for each component on its own, and components are spread over the cluster.  Phase one links
(``link``), phase two cuts (``cut``); what lies between is a table of linked components, their
nodes and neighbour links as plain columns, which can be written, read elsewhere and cut again
with other parameters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..kernel import component as kernel
from ..params import Params
from ..schemas import DOMAINS, LINKED, TREE
from .components import components

#: Edges of one component that a task takes; more are refused, as one component is one call.
MAX_EDGES = 5_000_000
SCHEMAS = {"domains": DOMAINS, "tree": TREE, "newick": "component bigint, cluster_id bigint, newick string"}


class ComponentTooLarge(ValueError):
    """A component has more edges than one kernel call takes."""


def link(genes: DataFrame, edges: DataFrame, params: Params, max_edges: int = MAX_EDGES) -> DataFrame:
    """LINKED of genes (species, gene, length[, trunc]) and admitted edges (id1, id2, from1..to2, score[, dist])."""
    labels = components(edges.select("id1", "id2"))
    tagged = edges.join(labels.select(F.col("id").alias("id1"), F.col("label").alias("component")), "id1")
    worst = tagged.groupBy("component").count().agg(F.max("count")).first()[0] or 0
    if worst > max_edges:
        raise ComponentTooLarge(f"a component has {worst} edges, more than {max_edges}; raise the missing score or the limit")
    p = params.resolved()
    low = None if p.by_score else edges.agg(F.min("dist")).first()[0]
    trunc = F.col("trunc") if "trunc" in genes.columns else F.lit(0)
    nodes = genes.join(labels.select(F.col("id").alias("gene"), F.col("label").alias("component")), "gene").select("component", "species", "gene", "length", trunc.alias("trunc"))
    dist = F.col("dist").cast("double") if "dist" in edges.columns else F.lit(p.miss_dist)
    lines = tagged.select("component", "id1", "id2", "from1", "to1", "from2", "to2", dist.alias("dist"), F.col("score").cast("double").alias("score"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own = left.sort_values("gene")
        hits = right.sort_values(["id1", "id2", "from1", "from2"])
        g = kernel.link(
            list(own[["species", "gene", "length", "trunc"]].itertuples(index=False, name=None)),
            list(hits[["id1", "id2", "from1", "to1", "from2", "to2", "dist", "score"]].itertuples(index=False, name=None)), params, low)
        nodes, links = kernel.dump(g)
        return pd.DataFrame({"component": [int(own["component"].iloc[0])], "n_edges": [len(hits)], "nodes": [nodes], "links": [links]})

    return nodes.groupBy("component").cogroup(lines.groupBy("component")).applyInPandas(run, LINKED)


def cut(linked: DataFrame, params: Params, kind: str) -> DataFrame:
    """The table ``kind`` (domains, tree or newick) of linked components, cut by ``params``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                component, nodes, links = (b.column(c)[k].as_py() for c in range(3))
                g = kernel.restore(nodes, links, params)
                yield pa.RecordBatch.from_pandas(kernel.frame(kind, kernel.rows(component, g, params)), schema=arrow, preserve_index=False)

    arrow = to_arrow_schema(StructType.fromDDL(SCHEMAS[kind]))
    return linked.select("component", "nodes", "links").mapInArrow(run, SCHEMAS[kind])


def hierarchy(linked: DataFrame, params: Params) -> DataFrame:
    """Members of orthologous groups under homologous ones: component, hom, cluster_id, species, gene, dom, from, to.

    The same merges are cut twice, not at all and by ``params``; a domain belongs to the homologous
    cluster whose domain of the gene covers most of it.
    """
    ortho, hom = cut(linked, params, "domains"), cut(linked, replace(params, homology=True), "domains")
    up = hom.select("component", "gene", F.col("cluster_id").alias("hom"), F.col("from").alias("hf"), F.col("to").alias("ht"))
    own = ["component", "cluster_id", "species", "gene", "dom", "from", "to"]
    shared = F.least("to", "ht") - F.greatest("from", "hf")
    best = F.max(F.struct(shared.alias("n"), (-F.col("hf")).alias("neg"), "hom"))
    return ortho.join(up, ["component", "gene"]).groupBy(*own).agg(best.alias("m")).select("component", F.col("m.hom").alias("hom"), *own[1:])


def named(rows: DataFrame, hom: str = "hom", cluster: str = "cluster_id", sub: str | None = None) -> DataFrame:
    """rows with ``name``: the cluster's id in flat tables, after its homologous group's, with the number of a subgroup (0: the outgroup's)."""
    name = F.concat(F.col(hom).cast("string"), F.lit("|"), F.col(cluster).cast("string"))
    return rows.withColumn("name", F.concat(name, F.lit("."), F.col(sub).cast("string")) if sub else name)


def neighbours(linked: DataFrame, ratio: float = 0.5) -> DataFrame:
    """component, node, neighbour, side ("L" or "R"): of each node the live neighbour that most of its genes share, if at least ``ratio`` do."""
    n = linked.select("component", F.inline("nodes")).select("component", F.col("id").alias("node"), "count")
    l = linked.select("component", F.inline("links")).filter("status = 0").withColumnRenamed("count", "shared")
    right = l.select("component", F.col("left").alias("node"), F.col("right").alias("neighbour"), F.lit("R").alias("side"), "shared")
    left = l.select("component", F.col("right").alias("node"), F.col("left").alias("neighbour"), F.lit("L").alias("side"), "shared")
    best = right.union(left).groupBy("component", "node", "side").agg(F.max(F.struct("shared", (-F.col("neighbour")).alias("neg"))).alias("m"))
    return best.join(n, ["component", "node"]).filter(F.col("m.shared") >= F.bround(F.col("count") * F.lit(ratio))).select("component", "node", (-F.col("m.neg")).alias("neighbour"), "side")
