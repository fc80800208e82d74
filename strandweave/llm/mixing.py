"""Mixing sources to target weights: hierarchical token budgets over a tree of domains, languages and sources.

The total budget goes down the tree.  Among siblings it is shared in proportion to
their weights; a sibling whose tokens (times the epochs allowed) fall short gives
the rest to its siblings first, again by weight, and only what a whole subtree
lacks reaches the siblings of its ancestor.  This water-filling is exact and in
whole tokens: siblings sorted by capacity / weight are full up to a point, the
others share what is left and round down.

A leaf with a budget of A tokens and T tokens of its own gives A div T whole epochs
and, of one more epoch, the first A mod T tokens in the order of
md5(seed|epoch|doc_id).  The document on the border gives its first tokens only
(``partial_tokens``).  The border is found without sorting a leaf: tokens are summed by
(leaf, hash range), with so many ranges that one holds about RANGE_ROWS rows, the border's
range is found digit by digit, a running sum over at most 16 sums a leaf each, and only that
range's rows are ordered.  All main-path code is DataFrame code.

Tokens are runs of characters other than space, tab and line breaks.  Defined
results: null and empty texts have no tokens, cost no budget and are taken with every
epoch that their leaf gives whole, or if they come up to the border; null levels
form leaves of their own; rows that repeat an id are taken or left together; leaves
without tokens, and empty tables, give no rows with a copy.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Leaves up to this count are broadcast with their budgets (a leaf takes some
#: hundred bytes); more leaves are joined by shuffle.
MAX_BROADCAST_LEAVES = 20_000
#: Rows that a hash range may hold, on average, if all rows were one leaf's; at least 16^LEAST_DIGITS ranges.
RANGE_ROWS = 1_000
LEAST_DIGITS = 3


@dataclass(frozen=True)
class Mix:
    """levels: (name, column) from the root down.  weights: per level, name to whole weight (others ``default``)."""

    levels: tuple[tuple[str, str], ...] = (
        ("domain", "concat('domain', try_cast(regexp_extract(source, '[0-9]+$', 0) as bigint) % 4)"),
        ("language", "lang"),
        ("source", "source"),
    )
    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    default: int = 1
    share_percent: int = 60
    max_epochs: int = 1
    seed: int = 7

    def __post_init__(self):
        if min([self.default, *(w for by in self.weights.values() for w in by.values())]) < 1:
            raise ValueError("weights are whole numbers from 1")


def n_tokens(text: Column) -> Column:
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[ \t\n\r]+"), lambda w: w != "")
    return F.size(words).cast("long")


def _weight(mix: Mix, level: str) -> Column:
    out = F.lit(mix.default)
    for name, w in sorted(mix.weights.get(level, {}).items()):
        out = F.when(F.col(f"l_{level}") == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def _big(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves: l_<level>..., tokens.  Adds ``budget``: the tokens that each leaf gives."""
    names = [f"l_{n}" for n, _ in mix.levels]
    total = leaves.agg(F.sum("tokens").cast("long")).first()[0] or 0
    tree = leaves.withColumn("capacity", F.col("tokens") * mix.max_epochs)
    tree = tree.withColumn("budget", F.lit(min(total * mix.share_percent // 100, total * mix.max_epochs)).cast("long"))
    for depth, (level, _) in enumerate(mix.levels):
        parent, node = names[:depth], names[: depth + 1]
        same = [F.coalesce(F.col(n), F.lit("\0")) for n in parent] or [F.lit(0)]
        w_node = Window.partitionBy(*same, F.coalesce(F.col(names[depth]), F.lit("\0")))
        rows = tree.withColumn("node_cap", F.sum("capacity").over(w_node)).withColumn("w", _weight(mix, level))
        nodes = rows.groupBy(*node, "w").agg(F.first("node_cap").alias("cap"), F.first("budget").alias("given"))
        nodes = nodes.withColumn("ratio", F.col("cap").cast("double") / F.col("w").cast("double"))
        fill = Window.partitionBy(*same).orderBy("ratio", F.col(names[depth]).asc_nulls_first())
        rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        past = fill.rowsBetween(Window.unboundedPreceding, -1)
        nodes = nodes.withColumn("w_rest", F.sum("w").over(rest)).withColumn("c_past", F.coalesce(F.sum("cap").over(past), F.lit(0)))
        full = _big("cap") * _big("w_rest") <= _big(F.col("given") - F.col("c_past")) * _big("w")
        nodes = nodes.withColumn("full", full)
        kin = Window.partitionBy(*same)
        nodes = nodes.withColumn("c_full", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(kin), F.lit(0)))
        nodes = nodes.withColumn("w_open", F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(kin), F.lit(0)))
        share = F.expr("cast((cast(given - c_full as decimal(38,0)) * cast(w as decimal(38,0))) div nullif(cast(w_open as decimal(38,0)), 0) as bigint)")
        nodes = nodes.select(*[F.col(n).alias("n" + n) for n in node], F.when(F.col("full"), F.col("cap")).otherwise(share).alias("next"))
        cond = [tree[n].eqNullSafe(nodes["n" + n]) for n in node]
        on = cond[0]
        for c in cond[1:]:
            on = on & c
        tree = tree.join(nodes, on).withColumn("budget", F.col("next")).drop("next", *["n" + n for n in node])
    return tree.select(*names, "tokens", "budget")


def plan(docs: DataFrame, mix: Mix) -> tuple[DataFrame, DataFrame]:
    """(rows, cuts): slim rows (doc_id, l_<level>..., tokens) and, by leaf, whole epochs and the border of the last one."""
    names = [f"l_{n}" for n, _ in mix.levels]
    slim = materialize(docs.select("doc_id", *[F.expr(e).alias(f"l_{n}") for n, e in mix.levels], n_tokens(F.col("text")).alias("tokens")), "mix-rows")
    leaf = F.sha2(F.concat_ws("\x01", *[F.coalesce(F.concat(F.lit("="), F.col(n)), F.lit("-")) for n in names]), 256)
    given = budgets(slim.groupBy(*names).agg(F.sum("tokens").cast("long").alias("tokens")), mix)
    epochs = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)).cast("long")
    given = given.withColumn("whole", epochs).withColumn("part", F.col("budget") - F.col("whole") * F.col("tokens"))
    given = materialize(given.withColumn("leaf", leaf).select("leaf", *names, F.col("tokens").alias("leaf_tokens"), "budget", "whole", "part"), "mix-budgets")
    few = given.count() <= MAX_BROADCAST_LEAVES
    hint = F.broadcast if few else (lambda d: d)
    key = F.md5(F.concat_ws("|", F.lit(str(mix.seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    digits, n = LEAST_DIGITS, slim.count()
    while n > RANGE_ROWS * 16**digits:
        digits += 1
    keyed = slim.withColumn("leaf", leaf).join(hint(given.filter("part > 0").select("leaf", "whole", "part")), "leaf").withColumn("key", key).withColumn("range", F.substring("key", 1, digits))
    sums = materialize(keyed.groupBy("leaf", "part", "range").agg(F.sum("tokens").alias("sum")), "mix-ranges")
    border = sums.select("leaf").distinct().select("leaf", F.lit("").alias("found"), F.lit(0).cast("long").alias("before"))
    upto = Window.partitionBy("leaf").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for k in range(1, digits + 1):
        inside = sums.join(hint(border), "leaf").filter(F.substring("range", 1, k - 1) == F.col("found")) if k > 1 else sums.join(hint(border), "leaf")
        by_digit = inside.groupBy("leaf", "part", "before", F.substring("range", 1, k).alias("digit")).agg(F.sum("sum").alias("sum"))
        crossed = by_digit.withColumn("upto", F.col("before") + F.sum("sum").over(upto)).filter((F.col("upto") >= F.col("part")) & (F.col("upto") - F.col("sum") < F.col("part")))
        border = crossed.select("leaf", F.col("digit").alias("found"), (F.col("upto") - F.col("sum")).alias("before"))
    border = border.select("leaf", F.col("found").alias("range"), "before")
    near = keyed.join(hint(border), ["leaf", "range"])
    inside = Window.partitionBy("leaf").orderBy("key", F.col("doc_id").asc_nulls_first())
    near = near.withColumn("upto", F.col("before") + F.sum("tokens").over(inside)).filter(F.col("upto") >= F.col("part"))
    at = near.groupBy("leaf").agg(F.min(F.struct("key", "upto")).alias("m"))
    at = at.select("leaf", F.col("m.key").alias("cut"), F.col("m.upto").alias("cut_upto"))
    cuts = given.join(at, "leaf", "left")
    return slim, materialize(cuts, "mix-cuts")


def selection(rows: DataFrame, cuts: DataFrame, mix: Mix) -> DataFrame:
    """Adds copies, partial (taken in the last epoch) and the leaf's figures to rows that have doc_id, l_<level>... and tokens."""
    cols = [f"l_{n}" for n, _ in mix.levels]
    hint = F.broadcast if cuts.count() <= MAX_BROADCAST_LEAVES else (lambda d: d)
    c = cuts.select(*[F.col(n).alias("c" + n) for n in cols], "leaf_tokens", "budget", "whole", "part", "cut", "cut_upto")
    on = F.lit(True)
    for n in cols:
        on = on & rows[n].eqNullSafe(c["c" + n])
    out = rows.join(hint(c), on).drop(*["c" + n for n in cols])
    key = F.md5(F.concat_ws("|", F.lit(str(mix.seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    out = out.withColumn("sw_key", key).withColumn("sw_in", F.coalesce(F.col("sw_key") <= F.col("cut"), F.lit(False)))
    last = F.when(~F.col("sw_in"), F.lit(0)).when(F.col("sw_key") == F.col("cut"), F.greatest(F.lit(0), F.col("tokens") - (F.col("cut_upto") - F.col("part")))).otherwise(F.col("tokens"))
    return out.withColumn("copies", (F.col("whole") + F.col("sw_in").cast("int")).cast("long")).withColumn("partial_tokens", last.cast("long")).drop("sw_key", "sw_in")
