"""Similarity measures and their corrections as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import Params


def kimura(identity: Column) -> Column:
    """Protein distance from a share of identical residues: -100 ln(1 - d - 0.2 d^2) with d = 1 - identity; null where undefined."""
    d = F.lit(1.0) - identity
    left = F.lit(1.0) - d - F.lit(0.2) * d * d
    return F.when(left > 0, -F.log(left) * 100)


def distance_of(params: Params, pam: Column, identity: Column) -> Column:
    """The distance a hit reports: PAM, or 100 - percent identity where ``identity`` is asked for."""
    return pam if params.by_score else F.lit(100.0) - identity


def coverage_of_shorter(len1: Column, len2: Column, ali1: Column, ali2: Column) -> Column:
    """Aligned share of the shorter gene; of the second one at equal length."""
    return F.when(len1 < len2, ali1 / len1).otherwise(ali2 / len2)


def covers(aligned: Column, length: Column, share: float) -> Column:
    return aligned >= length * F.lit(share)


def short_alignment_penalty(dist: Column, aligned: Column, shorter: Column, miss_dist: float, enough: int = 250) -> Column:
    """Distances of short alignments move towards the missing distance."""
    m = F.least(shorter, F.lit(enough))
    mixed = (dist * aligned + F.lit(float(miss_dist)) * (m - aligned)) / m
    return F.when((aligned < enough) & (aligned < m), mixed).otherwise(dist)


def tie_correction(score: Column, same: Column, across: Column, scale: int) -> Column:
    """One bucket more for hits within a species set, one less across the outgroup's border."""
    step = F.lit(1.0 / scale)
    return F.when(same, score + step).when(across, score - step).otherwise(score)


def better(a: Column, b: Column, params: Params) -> Column:
    return a > b if params.by_score else a < b


def weighted_mean(a: Column, n: Column, b: Column, m: Column, missing: float) -> Column:
    """Count-weighted mean of two measures, an absent one replaced by the missing value."""
    gap = F.lit(float(missing))
    return (F.coalesce(a, gap) * n + F.coalesce(b, gap) * m) / (n + m)


def modified_evalue(evalue: Column, qlen: Column, slen: Column) -> Column:
    return qlen.cast("double") * slen * evalue / 100000.0


def strip_plasmid(name: Column) -> Column:
    """The first ``_p:`` of a name becomes ``:``."""
    at = F.instr(name, "_p:")
    return F.when(at > 0, F.concat(F.substring(name, 1, at - 1), F.substr(name, at + 2))).otherwise(name)


def species_of(name: Column) -> Column:
    return F.split(name, ":", 2)[0]


def gene_of(name: Column) -> Column:
    return F.split(name, ":", 2)[1]


def domain_of(name: Column) -> Column:
    """The number in a trailing ``(n)``, or null."""
    return F.regexp_extract(name, r"\((\d+)\)$", 1).try_cast("int")


def formatted(value: Column, style: str) -> Column:
    """A number as text: "1" or "2" decimals, or "d", cut to a whole number."""
    return value.cast("bigint").cast("string") if style == "d" else F.format_string(f"%.{style}f", value.cast("double"))
