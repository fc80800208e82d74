"""Column functions against the kernel's plain Python, and on nulls."""

import random

import pytest
from pyspark.sql import functions as F

from strandweave.functions import measures, profiles, regions
from strandweave.kernel import geometry as geo
from strandweave.kernel.cutting import duplication
from strandweave.operators import edges, intervals
from strandweave.params import Params

P = Params().resolved()


@pytest.fixture(scope="module")
def pairs(spark):
    rnd = random.Random(1)
    data = []
    for _ in range(400):
        f1, f2 = rnd.randrange(1, 200), rnd.randrange(1, 200)
        data.append((f1, f1 + rnd.randrange(1, 150), f2, f2 + rnd.randrange(1, 150), rnd.randrange(-20, 400), rnd.randrange(0, 30)))
    return spark.createDataFrame(data, "f1 int, t1 int, f2 int, t2 int, p int, tol int")


def test_regions(pairs):
    e = [F.col(c) for c in ("f1", "t1", "f2", "t2")]
    n, m = regions.length(e[0], e[1]), regions.length(e[2], e[3])
    out = pairs.select("*", regions.overlap_cutoff(n, m).alias("cut"), regions.overlap_status(*e, F.col("tol")).alias("side"), regions.relation(*e, F.col("tol")).alias("rel"),
                       regions.transform(F.col("p"), *e).alias("to"), regions.mean_position(F.col("p"), F.lit(3), F.col("f1"), F.lit(2)).alias("mean"))
    for r in out.collect():
        a, b = (r.f1, r.t1), (r.f2, r.t2)
        assert r.cut == geo.least_overlap(geo.size(a), geo.size(b), P)
        assert r.side == geo.side(a, b, r.tol) and r.rel == geo.relation(a, b, r.tol)
        assert r.to == geo.moved(r.p, a, b) and r["mean"] == geo.mean(r.p, 3, r.f1, 2)


def test_overlap_join(pairs):
    data = pairs.select((F.col("tol") % 3).alias("k"), "f1", "t1", F.monotonically_increasing_id().alias("id")).cache()
    left = data.select("k", F.col("id").alias("a"), F.col("f1").alias("lf"), F.col("t1").alias("lt"))
    right = data.select("k", F.col("id").alias("b"), F.col("f1").alias("rf"), F.col("t1").alias("rt"))
    got = sorted((r.a, r.b) for r in intervals.overlap_join(left, right, "k", 7, width=32).collect())
    rows = data.collect()
    assert got == sorted((x.id, y.id) for x in rows for y in rows if x.k == y.k and min(x.t1, y.t1) - max(x.f1, y.f1) + 1 >= 7)


def test_nulls(spark):
    one = spark.createDataFrame([(None, None, 5, 9, 3)], "f1 int, t1 int, f2 int, t2 int, p int")
    e = [F.col(c) for c in ("f1", "t1", "f2", "t2")]
    r = one.select(regions.transform(F.col("p"), *e).alias("a"), regions.mean_position(F.col("f1"), F.lit(1), F.col("f2"), F.lit(1)).alias("b"), regions.overlap_ratio(*e).alias("c"),
                   measures.kimura(F.lit(0.1)).alias("d"), measures.weighted_mean(F.lit(None).cast("double"), F.lit(1), F.lit(4.0), F.lit(1), 2.0).alias("e"), measures.domain_of(F.lit("x")).alias("f")).first()
    assert tuple(r) == (None, 5, None, None, 3.0, None)


def test_profiles(spark):
    rnd = random.Random(2)
    data = [(rnd.getrandbits(25) or 1, rnd.getrandbits(25) or 1) for _ in range(200)] + [(1, 1), (1 << 24, 1 << 24)]
    d = spark.createDataFrame(data, "a bigint, b bigint")
    p = Params(cut_ratio=0.5, weak_ratio=0.3, balance=0.4).resolved()
    both = F.col("a").bitwiseOR(F.col("b"))
    got = d.select("*", profiles.duplication(both, F.col("a"), F.col("b"), 0.5, 0.3, 0.4).alias("cut"), profiles.weighted_count(F.col("a"), [1.0] * 25).alias("n"), profiles.includes(F.col("a"), F.col("b")).alias("inc")).collect()
    for r in got:
        assert r.cut == duplication(p, r.a | r.b, r.a, r.b) and r.n == r.a.bit_count() and r.inc == (r.a & r.b == r.b)
    words = spark.createDataFrame([([1, 3], [1])], "x array<bigint>, y array<bigint>")
    assert tuple(words.select(profiles.words_union(F.col("x"), F.col("y")), profiles.words_common(F.col("x"), F.col("y"))).first()) == ([1, 3], 1)


def test_canonical_and_best(spark):
    rows = [("b", "a", 1, 5, 2, 6, 10), ("a", "b", 3, 4, 3, 4, 12), ("c", "c", 1, 5, 1, 5, 9), ("c", "c", 8, 9, 1, 5, 9), ("a", "b", 1, 9, 1, 9, 12)]
    h = spark.createDataFrame(rows, "id1 string, id2 string, from1 int, to1 int, from2 int, to2 int, score int")
    got = sorted(tuple(r) for r in edges.canonical(h).collect())
    assert got == [("a", "b", 1, 9, 1, 9, 12), ("a", "b", 2, 6, 1, 5, 10), ("a", "b", 3, 4, 3, 4, 12), ("c", "c", 1, 5, 8, 9, 9)]
    best = edges.best_of_pair(edges.canonical(h), ["id1", "id2"], "from1", "from2")
    assert sorted((r.id1, r.id2, r.score, r.from1) for r in best.collect()) == [("a", "b", 12, 1), ("c", "c", 9, 1)]


def test_strip_plasmid(spark):
    d = spark.createDataFrame([("a_p:1",), ("a:1",), ("a_p:b_p:1",), (None,)], "n string")
    assert [r[0] for r in d.select(measures.strip_plasmid(F.col("n"))).collect()] == ["a:1", "a:1", "a:b_p:1", None]
