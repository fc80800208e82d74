"""Species sets as bit profiles: BIGINT up to 63 species, arrays of 63-bit words beyond."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 63


def bit(species_no: Column) -> Column:
    """A profile of one species; numbers outside of 0 to BITS - 1 are refused, as they would stand for other species."""
    fits = species_no.between(0, BITS - 1) | species_no.isNull()
    shifted = F.call_function("shiftleft", F.lit(1).cast("bigint"), species_no.cast("int"))
    return F.when(fits, shifted).otherwise(F.raise_error(F.concat(F.lit(f"a species number outside of 0 to {BITS - 1}: "), species_no.cast("string"))).cast("bigint"))


def words(species_nos: Column) -> Column:
    """Of an array of species numbers, the profile in words of BITS bits: any number of species."""
    size = F.coalesce(F.floor(F.array_max(species_nos) / BITS).cast("int") + 1, F.lit(0))
    one = lambda k: F.aggregate(F.filter(species_nos, lambda x: F.floor(x / BITS) == k), F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), (x % BITS).cast("int"))))
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), F.greatest(size, F.lit(1)) - 1), one)).otherwise(F.array().cast("array<bigint>"))


def mask_of(species: list[str], listed: list[str] | None = None, prefix: str | None = None) -> int:
    """The profile of a group of species: those listed, and those whose name starts with ``prefix``; bits by place in ``species``."""
    names = set(listed or ())
    return sum(1 << k for k, s in enumerate(species) if s in names or prefix is not None and s.startswith(prefix))


def union(profile: Column) -> Column:
    """Aggregate: the species of any row."""
    return F.bit_or(profile)


def count(profile: Column, ignored: int = 0) -> Column:
    return F.bit_count(profile.bitwiseAND(F.lit(~ignored).cast("bigint"))).cast("int")


def common(a: Column, b: Column, ignored: int = 0) -> Column:
    return count(a.bitwiseAND(b), ignored)


def minus(a: Column, b: Column) -> Column:
    return a.bitwiseAND(F.bitwise_not(b))


def includes(a: Column, b: Column) -> Column:
    """Whether every species of b is in a."""
    return a.bitwiseAND(b) == b


def mask_status(profile: Column, mask: int) -> Column:
    """0: no species in the mask, 2: all, 1: some."""
    inside = F.bit_count(profile.bitwiseAND(F.lit(mask).cast("bigint")))
    return F.when(inside == 0, 0).when(inside == F.bit_count(profile), 2).otherwise(1).cast("int")


def weighted_count(profile: Column, weights: list[float], once: list[int] = [], ignored: int = 0) -> Column:  # noqa: B006
    """Sum of the weights of the profile's species, and 1 for each of the masks ``once`` that it meets."""
    out = F.lit(0.0)
    for k, w in enumerate(weights):
        if w and not ignored >> k & 1:
            out = out + F.when(F.getbit(profile, F.lit(k)) == 1, F.lit(float(w))).otherwise(F.lit(0.0))
    for mask in once:
        out = out + F.when(profile.bitwiseAND(F.lit(mask).cast("bigint")) != 0, 1.0).otherwise(0.0)
    return out


def shares(shared, first, second, ratio: float, weak: float = 0.0, balance: float | None = None):
    """(alike, strong, doubtful) of two children's species counts, as numbers or Columns.

    alike: both have one species, the same; strong: they share more than ``ratio`` of either's;
    doubtful: more than ``weak`` of either's, or one has less than ``balance`` of the other's
    (without these two settings every pair is).
    """
    over = lambda part: (shared > first * part) | (shared > second * part)
    doubtful = (first < first + 1) if not weak and balance is None else (first < 0)
    if weak:
        doubtful = doubtful | over(weak)
    if balance is not None:
        doubtful = doubtful | (first < second * balance) | (second < first * balance)
    return (shared == 1) & (first == 1) & (second == 1), over(ratio), doubtful


def duplication(p0: Column, p1: Column, p2: Column, ratio: float, weak: float = 0.0, balance: float | None = None, ignored: int = 0) -> Column:
    """1: the children share too many species and are cut apart, 0: they stay, 2: to be decided by distance."""
    alike, strong, doubtful = shares(common(p1, p2, ignored), count(p1, ignored), count(p2, ignored), ratio, weak, balance)
    return F.when(alike, 0).when(strong, 1).when(doubtful, 2).otherwise(0).cast("int")


def words_union(a: Column, b: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, zero).bitwiseOR(F.coalesce(y, zero)))


def words_common(a: Column, b: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    both = F.zip_with(a, b, lambda x, y: F.coalesce(x, zero).bitwiseAND(F.coalesce(y, zero)))
    return F.aggregate(both, F.lit(0), lambda s, w: s + F.bit_count(w))
