"""The hash tree against a plain version, the movement that it allows on every level, and hot ids."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandweave.llm import common, sharding
from strandweave.llm.sharding import Tree


def plain_leaf(key, tree):
    """All draws of all processes, without stopping early."""
    weights = dict(tree.weights)
    weight = lambda x: weights.get(x, 1.0) if x < tree.shards else 0.0
    found = []
    for p in tree.processes():
        t = 0.0
        for j in range(sharding.TRIES):
            h = hashlib.md5(f"{p['name']}|{j}|{key}".encode()).hexdigest()
            part = lambda a, n: int(h[a - 1 : a - 1 + n], 16) / 16**n  # noqa: E731, B023
            t -= math.log(part(1, 13) + 0.5 / 16**13) / p["rate"]
            region = p["region"] + int(part(14, 6) * p["regions"])
            rack = region * tree.racks_per_region + int(part(20, 4) * tree.racks_per_region)
            leaf = rack * tree.per_rack + int(part(24, 4) * tree.per_rack)
            if p["floor"] + p["width"] * part(28, 5) < weight(leaf):
                found.append((t, leaf))
                break
    if found:
        return min(found)[1]
    draws = []
    for x in range(tree.shards):
        h = hashlib.md5(f"{tree.seed}|leaf|{x}|{key}".encode()).hexdigest()
        if weight(x):
            draws.append((-math.log(int(h[:13], 16) / 16**13 + 0.5 / 16**13) / weight(x), x))
    return min(draws)[1]


TREES = [Tree(1), Tree(24), Tree(25), Tree(61), Tree(5, per_rack=2, racks_per_region=2), Tree(24, weights=((5, 3.0), (7, 0.25))), Tree(13, weights=((12, 9.5),))]


@pytest.mark.parametrize("tree", TREES)
def test_plain_version(spark, tree):
    keys = spark.range(400).select(F.col("id").cast("string").alias("k"))
    got = {r[0]: r[1] for r in keys.select("k", sharding.descend(F.col("k"), tree)).collect()}
    assert got == {k: plain_leaf(k, tree) for k in got}


@pytest.mark.parametrize("old, new, leaf", [
    (Tree(24), Tree(25), 24), (Tree(12), Tree(13), 12), (Tree(48), Tree(49), 48), (Tree(24), Tree(24, weights=((5, 6.0),)), 5), (Tree(24, weights=((5, 6.0),)), Tree(24, weights=((5, 1.5),)), 5), (Tree(24), Tree(24, weights=((5, 0.0),)), 5),
])
def test_movement_is_confined_on_every_level(spark, old, new, leaf):
    """A row moves into the changed leaf, or out of it; so between regions and racks only those above that leaf gain or lose."""
    keys = spark.range(8_000).select(F.col("id").cast("string").alias("k"))
    rows = keys.select("k", sharding.descend(F.col("k"), old).alias("a"), sharding.descend(F.col("k"), new).alias("b")).collect()
    moved = [(r.a, r.b) for r in rows if r.a != r.b]
    assert moved and (all(b == leaf for _, b in moved) or all(a == leaf for a, _ in moved))
    for of in (old.per_rack, old.per_rack * old.racks_per_region):
        assert all(leaf // of in (a // of, b // of) for a, b in moved)
    weights = dict(new.weights)
    total = sum(weights.get(x, 1.0) for x in range(new.shards))
    count = Counter(r.b for r in rows)
    for x in range(new.shards):
        want = len(rows) * weights.get(x, 1.0) / total
        assert abs(count[x] - want) < 5 * math.sqrt(want + 1)


def test_hot_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    data = [(7, "same text")] * 300 + [(None, None)] * 200 + [(i, f"text {i}") for i in range(400)] + [(7, "other")] * 3
    got = sharding.place(spark.createDataFrame(data, "doc_id bigint, text string").repartition(6), Tree(3), Tree(4)).collect()
    assert len(got) == len(data)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append((r.slot, r.doc_id, r.text_crc32))
        assert r.grown_shard in (r["shard"], 3)
    for held in slots.values():
        assert [s for s, *_ in sorted(held)] == list(range(len(held)))
    same = sorted(r.slot for r in got if r.doc_id == 7 and r.text_crc32 == zlib.crc32(b"same text"))
    assert same == list(range(same[0], same[0] + 300))  # equal rows follow each other, so which is which does not matter
    monkeypatch.setattr(common, "HOT_ROWS", 10_000)
    cold = sharding.place(spark.createDataFrame(data, "doc_id bigint, text string"), Tree(3), Tree(4)).collect()
    assert sorted(map(str, got)) == sorted(map(str, cold))
