"""Sharding by a hierarchical weighted hash tree.

Shards are the leaves of a tree of regions and racks; every region has room for the same
number of racks, every rack for the same number of shards.  A document makes draws: each
descends from the root by one hash draw a level, to a region, a rack of it and a shard of
that, and has a moment, the moments being those of a Poisson process.  A draw counts if
its shard exists and weighs more than the draw's own level of weight.  The document goes
where its first draw that counts ends, so a shard gets documents in proportion to its weight,
and only the nodes on the paths of the draws before that are looked at.

Law ``key``: one more shard may take rows only into itself.  Independent choices among the
children of each node can't keep it: a region that grows would draw documents from other
regions into all of its racks.  So draws do not depend on which shards there are.  Room grows
by doubling: region 0, region 1, regions 2 and 3, regions 4 to 7 and so on have processes of
their own, and so have weights up to 1, from 1 to 2, from 2 to 4 and so on; a new shard or a
heavier one only makes draws count that did not, a lighter one takes that from some of its
own.  What moves, moves into or out of the leaf that changed, on every level: nothing moves
between two subtrees whose weights stay.

A process makes TRIES draws at most and stops at the best moment found before; where no
draw counts in any process (a tree with few shards in a large room), all shards draw against
each other, each with a moment of its own, which keeps the same law.

Slots are gapless within a shard without any task that holds a shard: rows are counted by
shard and range of a hash of id and text, range offsets come from a running sum over these
counts, and ranks are taken within ranges.  Rows that agree in id and text and are more than
HOT_ROWS and HOT_SHARE of all rows have ranges of their own, over which they are dealt.

Defined results: a null id is placed by its text's checksum; a null text has no bytes and
checksum 0; rows that repeat an id share a shard and get slots of their own; an empty table
gives no rows; columns other than doc_id and text play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import materialize

#: Hex digits of a hash that name a range of slots, at least; rows of a range, on average, at most.
SLOT_DIGITS = 3
SLOT_ROWS = 100_000
#: Parts that the rows of a hot id and text are dealt over.
SALTS = 64
TRIES = 32


@dataclass(frozen=True)
class Tree:
    """A tree of ``shards`` leaves, filled rack by rack and region by region.

    weights: of leaves that do not weigh 1.
    """

    shards: int
    per_rack: int = 4
    racks_per_region: int = 3
    seed: int = 20240229
    weights: tuple[tuple[int, float], ...] = ()

    def processes(self) -> list[dict]:
        """Processes that a leaf can take part in, those with the largest share of draws that count first."""
        weights, out = dict(self.weights), []
        room = self.per_rack * self.racks_per_region
        low = 0
        while low * room < self.shards:
            n = max(1, low)
            leaves = range(low * room, min(self.shards, (low + n) * room))
            floor = 0
            heaviest = max([1.0 if len(leaves) > len(weights) else 0.0, *(weights.get(x, 1.0) for x in leaves if x in weights)], default=0.0)
            while floor < heaviest:
                width = max(1, floor)
                others = len(leaves) - sum(x in leaves for x in weights)
                counts = others * min(1.0, max(0.0, 1.0 - floor) / width) + sum(min(1.0, max(0.0, w - floor) / width) for x, w in self.weights if x in leaves)
                out.append({"name": f"{self.seed}|{low}|{floor}", "region": low, "regions": n, "floor": float(floor), "width": float(width), "rate": float(n * room * width), "share": counts / (n * room)})
                floor += width
            low += n
        return sorted((p for p in out if p["share"]), key=lambda p: (-p["share"], p["name"]))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _digits(h: Column, start: int, n: int) -> Column:
    """A number in [0, 1) from n hex digits, 13 at most."""
    return F.conv(F.substring(h, start, n), 16, 10).cast("double") / float(16**n)


def _weight(tree: Tree, leaf: Column) -> Column:
    own = F.lit(1.0)
    if tree.weights:
        own = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, w in tree.weights for x in (k, float(w))]), leaf), own)
    return F.when(leaf < tree.shards, own).otherwise(0.0)


def _wait(h: Column, rate: Column) -> Column:
    """An exponential waiting time from a hash's first 13 digits."""
    return -F.log(_digits(h, 1, 13) + 0.5 / 16**13) / rate


def _first(key: Column, tree: Tree, p: Column, best: Column) -> Column:
    """struct(t, leaf): the process's first draw that counts, before the moment ``best``; leaf -1: none."""

    def draw(s: Column, j: Column) -> Column:
        def ended(h: Column) -> Column:
            part = lambda start, n, of: F.floor(_digits(h, start, n) * of).cast("int")
            region = p["region"] + part(14, 6, p["regions"])
            rack = region * tree.racks_per_region + part(20, 4, F.lit(tree.racks_per_region))
            leaf = rack * tree.per_rack + part(24, 4, F.lit(tree.per_rack))
            return _let(leaf, lambda x: F.struct(
                (s["t"] + _wait(h, p["rate"])).alias("t"),
                F.when(p["floor"] + p["width"] * _digits(h, 28, 5) < _weight(tree, x), x).otherwise(F.lit(-1)).alias("leaf")))

        return _let(F.md5(F.concat_ws("|", p["name"], j.cast("string"), key).cast("binary")), ended)

    start = F.struct(F.lit(0.0).alias("t"), F.lit(-1).alias("leaf"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), start, lambda s, j: F.when((s["leaf"] >= 0) | (s["t"] >= best), s).otherwise(draw(s, j)))


def descend(key: Column, tree: Tree) -> Column:
    """The leaf that a key (a string) reaches."""
    ps = F.array(*[F.struct(*[F.lit(p[n]).alias(n) for n in ("name", "region", "regions", "floor", "width", "rate")]) for p in tree.processes()])
    none = F.struct(F.lit(float("inf")).alias("t"), F.lit(-1).alias("leaf"))
    better = lambda best, p: _let(_first(key, tree, p, best["t"]), lambda f: F.when((f["leaf"] >= 0) & (f["t"] < best["t"]), f).otherwise(best))
    leaf = F.aggregate(ps, none, better)["leaf"]

    def all_draw() -> Column:
        def nearer(best: Column, x: Column) -> Column:
            w = _weight(tree, x)
            t = _wait(F.md5(F.concat_ws("|", F.lit(f"{tree.seed}|leaf"), x.cast("string"), key).cast("binary")), w)
            return _let(F.struct(F.when(w > 0, t).otherwise(float("inf")).alias("t"), x.alias("leaf")), lambda f: F.when(f["t"] < best["t"], f).otherwise(best))

        return F.aggregate(F.sequence(F.lit(0), F.lit(tree.shards - 1)), none, nearer)["leaf"]

    return _let(leaf, lambda x: F.when(x >= 0, x).otherwise(all_draw()))


def place(docs: DataFrame, tree: Tree, grown: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, region, rack, shard, slot and, with ``grown``, grown_shard of each row."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    slim = slim.withColumn("key", F.when(F.col("doc_id").isNull(), F.concat(F.lit("null "), F.col("text_crc32"))).otherwise(F.col("doc_id").cast("string")))
    rows = slim.withColumn("h", F.md5(F.concat_ws("|", F.lit(f"{tree.seed}|slot"), "key", F.col("text_crc32").cast("string")).cast("binary")))
    rows = rows.withColumn("shard", descend(F.col("key"), tree).cast("int")).withColumn("grown_shard", (descend(F.col("key"), grown) if grown else F.lit(None)).cast("int"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()).drop("key"), "placed")
    n = rows.count()
    digits = SLOT_DIGITS
    while n > SLOT_ROWS * tree.shards * 16**digits:
        digits += 1
    least = max(common.HOT_ROWS, int(n * common.HOT_SHARE))
    # At most 1 / HOT_SHARE of them, whatever the number of rows.
    hot = sorted(r[0] for r in rows.groupBy("h").count().filter(F.col("count") > least).select("h").collect()) if n > least else []
    rows = rows.withColumn("range", F.substring("h", 1, digits))
    if hot:
        listed = F.array(*[F.lit(x) for x in hot])
        past, own = F.size(F.filter(listed, lambda x: x < F.col("h"))), F.array_contains(listed, F.col("h"))
        rows = rows.withColumn("at", past * 2 + own.cast("int")).withColumn("salt", F.when(own, F.pmod(F.xxhash64("row"), F.lit(SALTS))).otherwise(0).cast("int"))
    else:
        rows = rows.withColumn("at", F.lit(0)).withColumn("salt", F.lit(0))
    where = ["shard", "range", "at", "salt"]
    counts = rows.groupBy(*where).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("range", "at", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*where, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy(*where).orderBy("h", "doc_id", "text_crc32", "size"))
    rack = F.floor(F.col("shard") / tree.per_rack).cast("int")
    return rows.withColumn("r", rank).join(offsets, where).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("r") - 1).cast("long").alias("slot"), "grown_shard",
        F.floor(rack / tree.racks_per_region).cast("int").alias("region"), rack.alias("rack"),
    )
