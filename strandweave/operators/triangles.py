"""Three genes that all hit each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import regions


def alignment_relations(hits: DataFrame, tol: int) -> DataFrame:
    """gene, a, b, r1, r2 for every hit of a < b that both hit gene: the relations of their regions on gene, and of the hit's own regions.

    Each triangle is found once, at the gene with the fewest hits, and gives a row for each of its genes; so two hits of one
    gene are paired no more often than the hits' number to the power of 1.5.  Relations that are known before a join go
    through it instead of regions.
    """
    tol = F.lit(tol)
    rel = lambda x, y: regions.relation(F.col(f"{x}_from"), F.col(f"{x}_to"), F.col(f"{y}_from"), F.col(f"{y}_to"), tol).cast("byte")
    hits = hits.select("id1", "id2", *[F.col(f"{end}{k}").alias(f"s{k}_{end}") for k in "12" for end in ("from", "to")])
    counts = hits.select(F.explode(F.array("id1", "id2")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    counted = hits.join(counts.toDF("id1", "n1"), "id1").join(counts.toDF("id2", "n2"), "id2")
    turn = F.col("n1") > F.col("n2")
    pick = lambda x, y: F.when(turn, F.col(y)).otherwise(F.col(x))
    ends = [pick(f"s{x}_{end}", f"s{y}_{end}").alias(f"{name}_{end}") for name, x, y in (("near", 1, 2), ("far", 2, 1)) for end in ("from", "to")]
    out = counted.select(pick("id1", "id2").alias("u"), pick("id2", "id1").alias("far"), *ends, rel("s1", "s2").alias("r")).repartition("u")
    v, w = (out.select("u", *[F.col(c).alias(c.replace("far", n).replace("near", f"u{n}") if c != "r" else f"r_u{n}") for c in out.columns[1:]]) for n in "vw")
    two = v.join(w, "u").filter(F.col("v") < F.col("w")).select("u", "v", "w", "v_from", "v_to", "w_from", "w_to", "r_uv", "r_uw", rel("uv", "uw").alias("r1_u"))
    third = hits.select(F.col("id1").alias("v"), F.col("id2").alias("w"), *[F.col(f"s{k}_{end}").alias(f"{n}2_{end}") for k, n in ((1, "v"), (2, "w")) for end in ("from", "to")], rel("s1", "s2").alias("r_vw"))
    all_three = two.join(third, ["v", "w"])
    row = lambda gene, a, b, r1, r2: F.struct(F.col(gene).alias("gene"), a.alias("a"), b.alias("b"), r1.cast("int").alias("r1"), F.col(r2).cast("int").alias("r2"))

    def seen_from(gene: str, other: str, r2: str) -> Column:
        """The row of a gene that has u and another as its neighbours."""
        before = F.col("u") < F.col(other)
        ends = [F.when(before, F.col(f"{x}_{end}")).otherwise(F.col(f"{y}_{end}")) for x, y in ((gene, f"{gene}2"), (f"{gene}2", gene)) for end in ("from", "to")]
        return row(gene, F.least("u", other), F.greatest("u", other), regions.relation(*ends, tol), r2)

    return all_three.select(F.inline(F.array(row("u", F.col("v"), F.col("w"), F.col("r1_u"), "r_vw"), seen_from("v", "w", "r_uw"), seen_from("w", "v", "r_uv"))))
