"""Hits in turns and triangles found once: the same rows with less on disk."""

import random
import time

from pyspark.sql import functions as F

from strandweave.functions import regions
from strandweave.operators import triangles
from strandweave.sources import bridge, shingles


def plain_hits(data, most=50):
    """Hits by loops over the words of (doc_id, text)."""
    runs = {}
    for doc, text in data:
        words = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in (text or "").lower()).split()
        for k in range(len(words) - 7):
            at = runs.setdefault(tuple(words[k : k + 8]), {})
            at[doc] = min(k + 1, at.get(doc, k + 1))
    out = {}
    for at in runs.values():
        if len(at) <= most:
            for a in at:
                for b in at:
                    if None not in (a, b) and a < b:
                        out.setdefault((a, b), []).append((at[a], at[b]))
    return sorted((a, b, min(p)[0], max(p)[0] + 7, min(y for _, y in p), max(y for _, y in p) + 7, len(p)) for (a, b), p in out.items())


def odd_texts():
    rng = random.Random(5)
    words = ["a", "b", "ab", "ba", "K9", "é", "naïve", "x" * 3000, "7", "Ünder", "a-b", "K"]
    texts = [(k, "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", ", "]) for _ in range(rng.randrange(40)))) for k in range(60)]
    common = " ".join(f"c{k}" for k in range(9))
    texts += [(100 + k, f"{common} p{k % 30} q r s t u v w x") for k in range(160)]
    return texts + [(3, texts[4][1]), (4, None), (None, texts[5][1]), (400, ""), (401, "one two"), (402, common)]


def files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(k).getName() for k in range(found.size()) if found.apply(k).getName().startswith("shuffle_")}


def test_no_shuffle_files_stay(spark, sf, monkeypatch):
    """Before, the files of the places stayed on disk until the driver collected its garbage."""
    monkeypatch.setattr(bridge, "_kept", {})
    before = files(spark)
    assert bridge.kept(spark, sf)[1].count() > 0
    until = time.time() + 10
    while (left := {f for f in files(spark) - before if f.endswith(".data")}) and time.time() < until:
        time.sleep(0.1)
    assert len(left) <= 1  # of the count above


def test_hits_of_odd_texts(spark, monkeypatch):
    data = odd_texts()
    docs = spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)
    want = plain_hits(data)
    assert len(want) > 100
    assert sorted(map(tuple, bridge.hits(docs).collect())) == want
    monkeypatch.setattr(bridge, "ONE_TURN", 0)
    monkeypatch.setattr(bridge, "HOT_ROWS", 2)
    monkeypatch.setattr(bridge, "BATCH_BYTES", 4000)
    assert sorted(map(tuple, bridge.hits(docs).collect())) == want
    texts = spark.createDataFrame([(f"d{k}", t) for k, t in data if k is not None], "doc_id string, text string")
    assert sorted(map(tuple, bridge.hits(texts).collect())) == plain_hits([(f"d{k}", t) for k, t in data if k is not None])


def test_a_run_of_many_documents_is_sent_once_a_batch(spark):
    docs = spark.createDataFrame([(k, "a b c d e f g h") for k in range(300)], "doc_id bigint, text string").coalesce(1)
    assert [tuple(r)[1] for r in shingles.sent(docs, 8, 64, 1, 0).collect()] == [shingles.MANY]
    parts = [shingles.sent(docs, 8, 300, 3, k).count() for k in range(3)]
    assert sorted(parts) == [0, 0, 300]


def test_triangles_against_loops(spark):
    rng = random.Random(3)
    hits = {}
    for a, b in [(0, k) for k in range(1, 120)] + [tuple(sorted(rng.sample(range(40), 2))) for _ in range(300)]:
        f1, f2 = rng.randrange(1, 60), rng.randrange(1, 60)
        hits[a, b] = (f1, f1 + rng.randrange(60), f2, f2 + rng.randrange(60))
    side = {**{(a, b): v[:2] for (a, b), v in hits.items()}, **{(b, a): v[2:] for (a, b), v in hits.items()}}
    want = [(g, a, b, *side[g, a], *side[g, b], *hits[a, b]) for a, b in hits for g in range(120) if (g, a) in side and (g, b) in side]
    assert len(want) > 300
    rel = lambda *c: regions.relation(*map(F.col, c), F.lit(10))
    want = spark.createDataFrame(want, "gene int, a int, b int, p int, q int, r int, s int, t int, u int, v int, w int").select("gene", "a", "b", rel("p", "q", "r", "s").alias("r1"), rel("t", "u", "v", "w").alias("r2"))
    table = spark.createDataFrame([(*k, *v) for k, v in hits.items()], "id1 int, id2 int, from1 int, to1 int, from2 int, to2 int")
    got = triangles.alignment_relations(table, 10)
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
