"""Results at the borders where queries could do less than the whole job."""

from strandweave.sources import bridge


def test_hits_of_all_runs(spark):
    text = " ".join(f"w{k}" for k in range(10))
    docs = spark.createDataFrame([(i, text) for i in range(51)] + [(60, "x " + text), (61, "other " * 9)], "doc_id bigint, text string")
    got = {tuple(r) for r in bridge.hits(docs, most=None).collect()}
    want = {(a, b, 1, 10, 1, 10, 3) for a in range(51) for b in range(a + 1, 51)} | {(a, 60, 1, 10, 2, 11, 3) for a in range(51)}
    assert got == want
    few = docs.filter("doc_id < 50")
    assert {tuple(r) for r in bridge.hits(few).collect()} == {tuple(r) for r in bridge.hits(few, most=None).collect()} == {r for r in want if r[1] < 50}


def test_hot_runs_are_dropped_before_they_are_dealt(spark, monkeypatch):
    """Runs that very many documents hold make no hit; taking them out early changes nothing, nor for a run that fills one document."""
    common = " ".join(f"c{k}" for k in range(9))
    data = [(i, f"{common} " + " ".join(f"p{i % 200}x{k}" for k in range(12))) for i in range(400)]
    data += [(900, "same words again and again and again now " * 60), (901, "same words again and again and again now same words")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    want = sorted(map(tuple, bridge.hits(docs).collect()))
    monkeypatch.setattr(bridge, "HOT_ROWS", 20)
    assert sorted(map(tuple, bridge.hits(docs).collect())) == want and len(want) >= 201
