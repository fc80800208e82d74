"""Choosing hits of packed tables: gene lists, thresholds, best hits, one hit a pair."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import besthit, edges
from .groups import numbered


@dataclass(frozen=True)
class Selection:
    """Thresholds that are None are not applied.  ends: "any", "both" or None for no best-hit test."""

    most_pam: float | None = None
    least_score: float | None = None
    most_evalue: float | None = None
    least_identity: float | None = None
    keep_self: bool = False
    identity_distance: bool = False
    near_best: float = 90.0
    ends: str | None = None
    once: bool = True
    #: Columns within whose values pairs are unique: with the name of a file, each file keeps its own.
    once_by: tuple[str, ...] = ()


def select(hits: DataFrame, s: Selection, names: DataFrame | None = None, both_listed: bool = False) -> DataFrame:
    """hits: id1, id2, species1, species2, from1..to2, ident, eval, score, pam.  Adds dist.

    Thresholds stand on stored columns and come first, so that they reach the scan.  Of the hits
    of a pair the highest score stays, with the least start as the tie's end.
    """
    out = hits
    for column, value, most in (("pam", s.most_pam, True), ("eval", s.most_evalue, True), ("score", s.least_score, False), ("ident", s.least_identity, False)):
        if value is not None:
            out = out.filter(F.col(column) <= value if most else F.col(column) >= value)
    if not s.keep_self:
        out = out.filter(F.col("id1") != F.col("id2"))
    if names is not None:
        out = (edges.both if both_listed else edges.either)(out, names, names.columns[0])
    out = out.withColumn("dist", (F.lit(100.0) - F.col("ident")) if s.identity_distance else F.col("pam"))
    if s.ends:
        out = besthit.near_best(out, s.near_best, s.ends).drop("best1", "best2")
    if s.once:
        out = edges.best_of_pair(edges.canonical(out), [*s.once_by, "id1", "id2"], "from1", "from2")
    return out


def by_score(hits: DataFrame) -> DataFrame:
    """Hits with a place from 1: the highest score first, of equal ones the least distance, then by ids."""
    return numbered(hits, "place", F.desc("score"), F.asc("pam"), F.asc("id1"), F.asc("id2"), F.asc("from1"), F.asc("from2"))
