"""Groups of groups, and where species stand in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import profiles
from .components import components


def unions(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(label, family): inner groups joined where they meet in an outer group.

    Both are (id, label).  Groups are the two sides of a graph, genes its edges; a family is a
    component of it.  Outer labels are kept apart from inner ones by their sign.
    """
    met = inner.select("id", F.col("label").alias("a")).join(outer.select("id", (-F.col("label") - 1).alias("b")), "id").select("a", "b").distinct()
    labels = components(met, "a", "b")
    families = labels.filter("id >= 0").select(F.col("id").alias("label"), F.col("label").alias("raw"))
    named = families.groupBy("raw").agg(F.min("label").alias("family"))
    return families.join(named, "raw").select("label", "family")


#: Where the two branches below a node stand.
PATTERNS = {(0, 0): "none", (1, 1): "in-in", (1, 2): "in-out", (2, 1): "in-out", (2, 2): "out-out", (1, 3): "in-both", (3, 1): "in-both", (2, 3): "out-both", (3, 2): "out-both", (3, 3): "both-both"}


def standing(profile: Column, outgroup: int) -> Column:
    """0: no species, 1: ingroup only, 2: outgroup only, 3: both."""
    out = profiles.count(profile.bitwiseAND(F.lit(outgroup).cast("bigint"))) > 0
    own = profiles.count(profile.bitwiseAND(F.lit(~outgroup).cast("bigint"))) > 0
    return own.cast("int") + out.cast("int") * 2


def pattern(p1: Column, p2: Column, outgroup: int) -> Column:
    a, b = standing(p1, outgroup), standing(p2, outgroup)
    found = F.lit("none")
    for (x, y), name in PATTERNS.items():
        found = F.when((a == x) & (b == y), F.lit(name)).otherwise(found)
    return found


def masked(groups: DataFrame, profile: str, mask: int) -> DataFrame:
    """Groups with at least one species of the mask."""
    return groups.filter(profiles.mask_status(F.col(profile), mask) > 0)
