"""Readers and writers on small files."""

import struct

import pytest
from pyspark.sql import functions as F

from strandweave.sources import text, tree


@pytest.fixture
def put(tmp_path):
    def f(name, data):
        (tmp_path / name).write_bytes(data if isinstance(data, bytes) else data.encode())
        return str(tmp_path / name)

    return f


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_sections_genes_hits(spark, put):
    path = put("in", "# c\nbsu A 100 5 1\nbsu B 90\neco C 80 7 -1 2\nbad\n//\nbsu:A eco:C 1 50 2 51 12.5 60\nbsu:A bsu:B 1 9 1 9 70\n\n# x\n")
    a, b = text.sections(spark, path)
    assert rows(text.genes(a)) == [("bsu", "A", 100, 5, 1, 0), ("bsu", "B", 90, None, None, 0), ("eco", "C", 80, 7, -1, 2)]
    assert rows(text.hits(b)) == [("bsu:A", "eco:C", 1, 50, 2, 51, 12.5, 60.0, 1), ("bsu:A", "bsu:B", 1, 9, 1, 9, 70.0, 70.0, 1)]
    assert rows(text.hits(b, by_score=False))[1][7] is None


def test_too_many_bad_rows(spark, put):
    lines = spark.read.text(put("g", "x\n" * 11 + "a b 5\n"))
    with pytest.raises(text.BadRows):
        text.genes(lines)
    assert text.genes(spark.read.text(put("h", "x\n" * 10 + "a b 5\n"))).count() == 1


def test_blast(spark, put):
    path = put("b", "a:1\tb:2\t90.0\t100\t0\t0\t1\t100\t3\t102\t1e-30\t55.5\nb:2\ta:1\t80.0\t90\t0\t0\t3\t92\t1\t90\t1e-20\t44\nx:1\ty:1\t10.0\t9\t0\t0\t1\t9\t1\t9\t1.0\t9\n")
    got = rows(text.blast_table(spark, path))
    assert got[0][6] == pytest.approx(10.7585, abs=1e-3) and got[2][6] is None
    best = {r[0]: r for r in rows(text.best_rows(text.blast_table(spark, path)))}
    assert best["a:1"][:8] == ("a:1", "b:2", 1, 100, 3, 102, 11.0, 167.0) or best["a:1"][7] in (166.0, 167.0)


def test_fasta(spark, put):
    got = sorted(rows(text.fasta(spark, put("f", ">a:1 some title\nACDE\nFG\n>b:2\nAA\n"))))
    assert got == [("a", "1", 6, "some title"), ("b", "2", 2, None)]


def test_clusters(spark, put):
    path = put("c", "Cluster 1\na:1(2) 5 90\nb:2 1 80\n\nCluster 2\na:1(1) 1 4\nSubCluster 1\nc:3 1 9\nOutGroup\nd:4 2 8\n\n")
    got = sorted(rows(text.clusters(spark, path)), key=str)
    assert [(r[0], r[3], r[4], r[5], r[6], r[7]) for r in got] == [("1", "a", "1", 2, 5, 90), ("1", "b", "2", 1, 1, 80), ("2", "c", "3", 1, 1, 9), ("2", "d", "4", 1, 2, 8), ("2", "a", "1", 1, 1, 4)]


def test_representatives(spark, put):
    got = rows(text.representatives(spark, put("r", "* a:1\n  b:2\n  c:3\n* d:4\n")))
    assert got == [("a:1", "a:1"), ("a:1", "b:2"), ("a:1", "c:3"), ("d:4", "d:4")]


def test_binary(spark, put):
    rec = struct.pack("=80s80s4H2f", b"a:1", b"b:2", 1, 50, 2, 51, 12.5, 60.0)
    assert rows(text.edges_binary(spark, put("e", bytes([text.MAGIC]) + rec))) == [("a:1", "b:2", 1, 50, 2, 51, 12.5, 60.0)]
    packed = struct.pack("=38s38s4H4f", b"a:1", b"b:2", 1, 5, 2, 6, 99.0, 0.5, 60.0, 3.0)
    assert rows(text.packed_binary(spark, put("p", packed * 2)))[1] == ("a:1", "b:2", 1, 5, 2, 6, 99.0, 0.5, 60.0, 3.0)
    assert text.is_binary(bytes([197, 1])) and not text.is_binary(b"a")
    assert rows(text.packed_text(spark, put("t", "a:1 b:2 1 5 2 6 99 0.5 60 3\n"))) == [("a:1", "b:2", 1, 5, 2, 6, 99.0, 0.5, 60.0, 3.0)]


def test_partitions_are_pruned(spark, tmp_path):
    hits = spark.createDataFrame([("b:1", "a:2", 5), ("a:1", "b:3", 6), ("c:1", "a:1", 7)], "id1 string, id2 string, score int")
    text.write_partitioned(hits, f"{tmp_path}/x")
    got = text.read_pairs(spark, f"{tmp_path}/x", [("b", "a")])
    assert sorted(r.score for r in got.collect()) == [5, 6]
    assert len(got.inputFiles()) >= 1 and got.filter(F.col("sp1") == "c").count() == 0


def test_tree(spark):
    t = "((a,b)[ab]:2 {c d}) # all\n"
    nodes = tree.parse(t)
    assert [(n.parent_id, n.species, n.label, n.weight) for n in nodes] == [(None, None, None, 1.0), (0, None, "ab", 1.0), (1, "a", None, 1.0), (1, "b", None, 1.0), (0, None, None, 1.0), (4, "c", None, 0.0), (4, "d", None, 0.0)]
    assert nodes[0].bits == 0b1111 and nodes[1].bits == 0b11 and nodes[4].once
    assert tree.load(spark, t).count() == 7
    for bad in ("(a", "a)"):
        with pytest.raises(ValueError):
            tree.parse(bad)
    many = "(" + " ".join(f"s{i}" for i in range(130)) + ")"
    assert tree.load(spark, many).filter("parent_id is null").first().profile == [2**63 - 1, 2**63 - 1, 2**4 - 1]
    assert tree.parse(tree.nested([(1, "root", []), (2, "x", ["a", "b"]), (2, "y", ["c"])]))[0].bits == 0b111


def test_scratch_tables_go(spark):
    import os

    from pyspark.sql import functions as F

    from strandweave import storage

    root = storage.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    with storage.scratch(spark):
        a = storage.materialize(spark.range(3), "a")
        kept = storage.materialize(a.select((F.col("id") + 1).alias("n")), "b", keep=True)
        assert a.count() == 3
    left = set(os.listdir(root)) - before
    assert len(left) == 1 and left.pop().startswith("b-") and sorted(r.n for r in kept.collect()) == [1, 2, 3]


def test_clusters_of_many_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a").write_text("Cluster 1\na:1 1 9\nSubCluster 2\nb:1 1 9\n\nCluster 2\nc:1 1 9\n")
    (tmp_path / "x" / "b").write_text("Cluster 1\nd:1 1 9\n\nCluster 7\ne:1 1 9\nOutGroup\nf:1 1 9\n\nCluster 7\ng:1 1 9\n")
    got = sorted((r.file[-1], r.cluster, r.species, r.subcluster, r.outgroup) for r in text.clusters(spark, str(tmp_path / "x")).collect())
    assert got == [("a", "1", "a", None, False), ("a", "1", "b", "2", False), ("a", "2", "c", None, False), ("b", "1", "d", None, False), ("b", "7", "e", None, False), ("b", "7", "f", None, True), ("b", "7", "g", None, False)]


def test_malformed_hits_are_counted(spark, put):
    good = "a:1 b:2 1 5 2 6 99 0.5 60 3\n"
    assert text.packed_text(spark, put("t1", good + "a:1 b:2 1 5\n# note\n\n" * 2 + "a b x 5 2 6 99 0.5 60 3\n")).count() == 1
    with pytest.raises(text.BadRows):
        text.packed_text(spark, put("t2", good + "a:1 b:2 1 5\n" * 3), most_bad=2)
    line = "a:1\tb:2\t90.0\t100\t0\t0\t1\t100\t3\t102\t1e-30\t55.5\n"
    assert text.blast_table(spark, put("t3", "# head\n" + line + "a\tb\n")).count() == 1
    with pytest.raises(text.BadRows):
        text.blast_table(spark, put("t4", line + "a\tb\n" * 3), most_bad=2)


def test_fasta_titles(spark, put):
    got = sorted(rows(text.fasta(spark, put("f", ">a:1 from A>B or so\nACDE\nFG\n>b:2\nAA\n>c:3 x > y\n\nA\n"))))
    assert got == [("a", "1", 6, "from A>B or so"), ("b", "2", 2, None), ("c", "3", 1, "x > y")]


def test_sniffing(spark, put, tmp_path):
    rec = struct.pack("=80s80s4H2f", b"a:1", b"b:2", 1, 50, 2, 51, 12.5, 60.0)
    want = ("a:1", "b:2", 1, 50, 2, 51, 12.5, 60.0, 1)
    line = "a:1 b:2 1 50 2 51 12.5 60\n"
    for name, data in (("bin", bytes([text.MAGIC]) + rec), ("plain", line), ("both", "a 1 100\nb 2 90\n//\n" + line)):
        assert rows(text.edges(spark, put(name, data))) == [want]
    (tmp_path / "folder").mkdir()
    (tmp_path / "folder" / "_x").write_text("no")
    (tmp_path / "folder" / "f").write_bytes(bytes([text.MAGIC]) + rec)
    assert text.first_bytes(spark, str(tmp_path / "folder"), 4) == (bytes([text.MAGIC]) + rec)[:4]
    assert text.first_bytes(spark, put("empty", "")) == b""


def test_folder_settings(spark, put):
    got = text.folder_settings(spark, put("info", "uniqcheck=0\nprefix=hom.\n# x\nsuffix=.txt\ndelim=_+\nother=1\n"))
    assert got == {"uniqcheck": 0, "idxfile": None, "prefix": "hom.", "suffix": ".txt", "delim": "_"}
    assert text.folder_settings(spark, put("none", "x\n"))["uniqcheck"] == 1
