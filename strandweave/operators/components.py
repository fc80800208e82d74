"""Connected components by rounds of least labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, scratch


def components(edges: DataFrame, a: str = "id1", b: str = "id2") -> DataFrame:
    """(id, label): the least id of each component.

    A round takes the least label of the neighbours, summed before the shuffle, then the
    label's own label, which halves paths; each round's table is written, so lineage stays short.
    """
    spark = edges.sparkSession
    with scratch(spark):
        both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).union(edges.select(F.col(b).alias("a"), F.col(a).alias("b"))).distinct()
        both = materialize(both, "component-edges")
        labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
        while True:
            near = both.join(labels, both["b"] == labels["id"]).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("near"))
            step = labels.join(near, labels["id"] == near["n"]).select("id", F.col("label").alias("old"), F.least("label", "near").alias("next"))
            up = labels.select(F.col("id").alias("u"), F.col("label").alias("up"))
            new = materialize(step.join(up, step["next"] == up["u"], "left").select("id", "old", F.least("next", F.coalesce("up", "next")).alias("label")), "labels")
            labels = new.select("id", "label")
            if not new.filter(F.col("old") != F.col("label")).take(1):
                return materialize(labels, "components", keep=True)
