"""The pipeline against plain Python, stage by stage, and on odd rows."""

import zlib
from collections import defaultdict

import corpus_pipeline
from strandweave.llm import toxicity
from strandweave.llm.common import table
from strandweave.llm.registry import PIPELINE_MIX

from .test_operators import plain_classes, plain_judge, plain_mix


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "minhash near-dedup", "benchmark decontamination", "mixing sources", "sharding"]
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        kept.append(rows(docs))
        docs = stage(spark, docs, sf)
        if docs.columns != ["doc_id", "size", "text_crc32", "region", "rack", "shard", "slot"]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    start, clean, single, safe, mixed = kept
    scorer = toxicity.Scorer(toxicity.fit(table(spark, sf, "documents"), table(spark, sf, "labels")))
    assert clean == [r for r in start if scorer(r[1]) < toxicity.THRESHOLD] and len(clean) < len(start)
    classes = plain_classes({r[0]: r[1] for r in clean})
    assert single == [r for r in clean if classes[r[0]] == r[0]] and len(single) < len(clean)
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    assert safe == [r for r in single if not plain_judge(r[1], items)[-1]] and len(safe) < len(single)
    taken = {r[0] for r in plain_mix(safe, PIPELINE_MIX) if r[6] > 0}
    assert mixed == [r for r in safe if r[0] in taken] and len(mixed) < len(safe)
    last = docs.collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in last) == sorted((r[0], len(r[1].encode()) + 8, zlib.crc32(r[1].encode())) for r in mixed)
    slots = defaultdict(list)
    for r in last:
        slots[r["shard"]].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert rows(corpus_pipeline.run(spark, sf)) == rows(docs)


def test_odd_rows(spark, sf, edge_docs, clash_docs, no_docs):
    for docs in (edge_docs, clash_docs, no_docs):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == columns
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
