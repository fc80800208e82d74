"""Taxa, numbering, comparison by domains, outgroups and unknown genes on small tables."""

import pytest
from pyspark.sql import functions as F

from strandweave.functions import profiles, regions
from strandweave.kernel import component as k
from strandweave.operators import edges, groups, taxonomy
from strandweave.params import Params


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_equal_rows_keep_their_taxa(spark):
    tree = spark.createDataFrame([(0, 0, 7), (1, 1, 3), (2, 1, 4), (3, 2, 1)], "node_id int, depth int, profile bigint")
    data = spark.createDataFrame([("x", 1), ("x", 1), ("y", 3), ("z", 5), ("n", 8), ("m", None)], "g string, p bigint")
    assert rows(taxonomy.least_taxon(data, tree, "p")) == sorted([("x", 1, 3), ("x", 1, 3), ("y", 3, 1), ("z", 5, 0), ("n", 8, None), ("m", None, None)], key=repr)


def test_tree_labels(spark):
    tree = spark.createDataFrame([(0, None, "root", None), (1, 0, "only", None), (2, 1, None, "a"), (3, 0, "two", None), (4, 3, None, "b"), (5, 3, "own", "c")], "node_id int, parent_id int, label string, species string")
    assert dict(rows(taxonomy.labels(tree))) == {0: "root", 1: "only", 2: "only", 3: "two", 4: "b", 5: "own"}


def test_numbers(spark):
    data = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 3).alias("w"))
    got = groups.numbered(data, "n", F.desc("w"), F.asc("v")).collect()
    want = sorted(((r.w, r.v) for r in got), key=lambda x: (-x[0], x[1]))
    assert [(r.w, r.v) for r in sorted(got, key=lambda r: r.n)] == want and sorted(r.n for r in got) == list(range(1, 1001))
    assert groups.numbered(data.limit(0), "n", F.asc("v")).count() == 0


def test_match_by_domains(spark):
    ours = spark.createDataFrame([("g", 1, 1, 100), ("g", 2, 101, 200), ("h", 1, 1, 50)], "gene string, label bigint, `from` int, `to` int")
    theirs = spark.createDataFrame([("g", 7, 1, 90), ("g", 8, 95, 200), ("h", 8, 1, 50)], "gene string, label bigint, `from` int, `to` int")
    # Of cluster 1 the domain of g is in 7 and that of h in 8; 8 also holds g, but elsewhere.
    assert rows(groups.best_match_domains(ours, theirs).select("label", "best", "common")) == [(1, 7, 1), (2, 8, 1)]
    assert rows(groups.mean_length(ours, "label")) == [(1, 75), (2, 100)]
    names = spark.createDataFrame([("g", "G1"), ("g", "G2")], "gene string, name string")
    assert [r[0] for r in rows(groups.cross_named(ours.filter("label = 1"), names))] == ["G1", "G2", "h"]


def test_regions_move_and_turn(spark):
    d = spark.createDataFrame([(3, 7)], "f int, t int")
    a, b = regions.shifted(F.col("f"), F.col("t"), F.lit(10))
    c, e = regions.reversed_(F.col("f"), F.col("t"), F.lit(20))
    assert tuple(d.select(a, b, c, e).first()) == (13, 17, 14, 18)


def test_species_numbers_beyond_a_word(spark):
    with pytest.raises(Exception, match="species number"):
        spark.range(64, 65).select(profiles.bit(F.col("id")).alias("p")).collect()
    d = spark.createDataFrame([([0, 62, 63, 130],), ([],), ([5, 5],)], "s array<int>")
    assert [r[0] for r in d.select(profiles.words(F.col("s"))).collect()] == [[1 | 1 << 62, 1, 1 << 4], [], [32]]


def test_unknown_genes_are_refused_or_skipped(spark):
    genes = spark.createDataFrame([("s", "a", 100), ("t", "b", 100)], "species string, gene string, length int")
    hits = spark.createDataFrame([("a", "b", 1, 50, 1, 50, 90), ("a", "x", 1, 50, 1, 50, 90), ("a", "y", 1, 50, 1, 50, 1)], "id1 string, id2 string, from1 int, to1 int, from2 int, to2 int, score int")
    with pytest.raises(edges.UnknownGenes):
        edges.edges_of(hits, genes, Params(cutoff=60))
    assert edges.edges_of(hits, genes, Params(cutoff=60, skip_unknown=True)).count() == 1
    out = {r.id2: r.score for r in edges.edges_of(hits, genes, Params(cutoff=60, skip_unknown=True), ["t"]).collect()}
    assert out == {"b": 90 - 1 / 40}


def test_connections(spark):
    e = spark.createDataFrame([("a", "b", 9, 1), ("a", "c", 5, 2), ("b", "c", 4, 3), ("b", "d", 3, 65_535), ("a", "d", 2, 1)], "id1 string, id2 string, score int, links int")
    assert rows(edges.connections(e, "a", "b")) == [("c", 5, 9), ("d", 65_535, 5)]


def test_outgroup_only_clusters_go():
    genes = [("a", "1", 300, 0), ("b", "2", 300, 0), ("c", "3", 300, 0), ("d", "4", 300, 0)]
    hits = [("1", "2", 1, 300, 1, 300, 10, 200.0), ("3", "4", 1, 300, 1, 300, 10, 200.0)]
    species = lambda p: sorted({r[2] for r in k.rows(0, k.link(genes, hits, p))["domains"]})
    assert species(Params(cutoff=60)) == ["a", "b", "c", "d"]
    assert species(Params(cutoff=60, outgroup=("c", "d"))) == ["a", "b"] == species(Params(cutoff=60, outgroup=("d", "c", "x")))
    assert species(Params(cutoff=60, outgroup=("d",))) == ["a", "b", "c", "d"]
    nodes, links = k.dump(k.link(genes, hits, Params(cutoff=60)))
    out = Params(cutoff=60, outgroup=("c", "d"))
    assert sorted({r[2] for r in k.rows(0, k.restore(nodes, links, out), out)["domains"]}) == ["a", "b"]


def test_neighbours_of_nodes(spark):
    from strandweave.operators import cluster

    genes = spark.createDataFrame([("a", "1", 500), ("b", "2", 500), ("c", "3", 250), ("d", "4", 250)], "species string, gene string, length int")
    hits = spark.createDataFrame([("1", "2", 1, 500, 1, 500, 400.0), ("1", "3", 1, 250, 1, 250, 200.0), ("2", "3", 1, 250, 1, 250, 210.0), ("1", "4", 251, 500, 1, 250, 190.0), ("2", "4", 251, 500, 1, 250, 195.0)],
                                 "id1 string, id2 string, from1 int, to1 int, from2 int, to2 int, score double")
    p = Params(cutoff=60.0)
    as_long = lambda df, *cols: df.select(*[F.col(c).cast("long").alias(c) if c in cols else F.col(c) for c in df.columns])
    linked = cluster.link(as_long(genes, "gene"), as_long(hits, "id1", "id2"), p)
    both = rows(cluster.neighbours(linked))
    assert both and all((c, m, n, "L" if s == "R" else "R") in both for c, n, m, s in both)
    tree = cluster.hierarchy(linked, p).collect()
    assert len(tree) == 6 and all(r.hom >= r.cluster_id for r in tree)
    assert {r.name for r in cluster.named(cluster.hierarchy(linked, p).withColumn("sub", F.lit(0)), sub="sub").collect()} == {f"{r.hom}|{r.cluster_id}.0" for r in tree}
