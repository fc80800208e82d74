from pyspark.sql import functions as F

from strandweave.sources import report, sinks

MATRIX = "# test\n   " + " ".join(report.LETTERS) + "\n" + "\n".join(a + " " + " ".join("4" if a == b else "-1" for b in report.LETTERS) for a in report.LETTERS)
REPORT = """BLASTP 2.2

Query= a:1 some protein
         (1,120 letters)

>b:2 other
          Length = 300

 Score = 55.5 bits (132), Expect = 1e-30
 Identities = 20/25 (80%)

Query: 1   ACDEFGHIKL 10
           ACDEFGHIKL
Sbjct: 3   ACDEFGHIKL 12

Query: 11  MN-PQRSTVW 19
Sbjct: 13  MNAPQRSTVW 22

 Score = 20 bits (40), Expect = 5.0
 Identities = 5/9 (55%)
Query: 30  ACD 32
Sbjct: 40  ACD 42
>a:1 some protein
          Length = 1120
 Score = 99 bits (99), Expect = e-90
 Identities = 9/9 (100%)
Query: 1 ACDEFGHIKL 10
Sbjct: 1 ACDEFGHIKL 10
  Database: x
"""


def test_matrix():
    m = report.Matrix.parse(MATRIX)
    assert m.score("AC", "AC") == 8 and m.score("A-C", "AAC") == 8 - 12 and m.score("A--C", "AAAC") == 8 - 13 and m.score("AX", "AC") == 4
    assert abs(sum(m.frequencies.values()) - 1) < 1e-9 and m.expected < 0
    assert m.bias("A" * 30, "A" * 30, 120) < m.bias("ACDEFGHIKLMNPQRSTVWY", "ACDEFGHIKLMNPQRSTVWY", 80)


def test_reports(spark, tmp_path):
    (tmp_path / "r").write_text(REPORT)
    m = report.Matrix.parse(MATRIX)
    got = [tuple(r)[:12] for r in report.read(spark, str(tmp_path / "r"), m, least_bias=-99).collect()]
    assert got == [("a:1", "b:2", 1120, 300, 1, 19, 3, 22, 80, 1e-30, 55.5, 19 * 4 - 12)]
    every = report.read(spark, str(tmp_path / "r"), m, most_evalue=99, least_bias=-99, keep_self=True)
    assert every.count() == 3 and report.read(spark, str(tmp_path / "r"), m, most_evalue=99, least_bias=-99, first_only=True).count() == 1
    (tmp_path / "x").write_text("not a report")
    assert report.read(spark, str(tmp_path / "x"), m).count() == 0
    rounds = REPORT.replace("\n>b:2", "\nResults from round 1\n>b:2").replace("\n>a:1", "\nResults from round 2\n>a:1")
    (tmp_path / "p").write_text(rounds)
    assert [r.id2 for r in report.read(spark, str(tmp_path / "p"), m, least_bias=-99, keep_self=True, last_round=2).collect()] == ["a:1"]


def test_graphs(spark, tmp_path):
    rows = [(0, 5, 5, None, 0, 70.0, 1.0, None, None, None, None), (0, 5, 1, 5, 0, None, None, "a:1", 1, 1, 9), (0, 5, 2, 5, 1, None, None, "b:2", 1, 1, 9)]
    t = spark.createDataFrame(rows, "component bigint, cluster_id bigint, node_id bigint, parent_id bigint, side int, score double, dist double, gene string, dom int, `from` int, `to` int")
    assert sorted(r.value for r in sinks.graph(t).collect()) == ["5 1", "5 2"]
    text = sinks.dot(t).first().value
    assert text.startswith("digraph {") and "n5 -> n2;" in text and 'label="70.0"' in text
    assert [tuple(r) for r in sinks.scores(t).collect()] == [(0, 5, 70.0, 1.0)]
    sinks.write_text(sinks.graph(t), f"{tmp_path}/g")
    assert spark.read.text(f"{tmp_path}/g").filter(F.length("value") > 0).count() == 2
