"""The composed grammar against plain loops, and a whole fit and score against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.llm import toxicity as tox
from strandweave.llm import transducer as t

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_clause(symbols):
    """What the docstring says, by looking at all pairs of symbols."""
    total = 0.0
    for p, kind, weight in symbols:
        if kind not in (t.INSULT, t.THREAT):
            continue
        targets = [q for q, k, _ in symbols if k == t.TARGET]
        if kind == t.THREAT:
            weight = t.FIXED_WEIGHT * weight if targets else 0.0
        elif any(abs(p - q) <= t.NEAR for q in targets):
            weight *= t.TARGETED
        if any(k == t.NEGATION and 0 < p - q <= t.NEAR for q, k, _ in symbols):
            weight *= t.NEGATED
        if any(k == t.REPORT and q < p for q, k, _ in symbols):
            weight *= t.REPORTED
        total += weight
    return total


@pytest.mark.parametrize("seed", range(200))
def test_composed_grammar(seed):
    rnd = random.Random(seed)
    at = sorted(rnd.sample(range(30), rnd.randint(1, 14)))
    symbols = [(p, k, rnd.choice((1.0, 2.5)) if k == t.INSULT else 1.0) for p in at for k in [rnd.randint(1, 5)]]
    assert tox.clause_score(symbols) == pytest.approx(plain_clause(symbols))


def test_transducers_compose_and_count():
    a, b = t.negation(), t.report()
    both = a.then(b)
    word = [t.NEGATION, t.OTHER, t.INSULT, t.REPORT, t.INSULT, t.INSULT]
    one, wa = a.run(word)
    _, wb = b.run(one)
    assert both.run(word)[1] == pytest.approx([x * y for x, y in zip(wa, wb, strict=True)])
    assert len(both.arcs) == (t.NEAR + 1) * 2 and wa == [1, 1, t.NEGATED, 1, 1, 1]
    plain = [(0, t.TARGET, 1.0), (1, t.NEGATION, 1.0), (2, t.INSULT, 2.0), (4, t.REPORT, 1.0), (9, t.THREAT, 1.0)]
    scores = {w: t.Grammar(frozenset(w.split()))(plain) for w in ("", "negation", "report", "target")}
    assert scores["negation"] > scores[""] < scores["report"] and scores["target"] < scores[""]


def plain_terms(text):
    words = [w.encode() for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    out = {b"=" + w for w in words}
    for n in tox.BEGINNINGS:
        for start in {w[:n] for w in words if len(w) >= n}:
            k = sum(w[:n] == start for w in words if len(w) >= n)
            out.add(b"<" + start)
            if k >= 2 and k * 128 >= len(words):
                out.add(b"+" + start)
    return out


def plain_evidence(text, model):
    classes = {w: k for k, ws in ((t.REPORT, tox.REPORTS), (t.NEGATION, tox.NEGATIONS), (t.TARGET, tox.TARGETS), (t.THREAT, tox.THREATS)) for w in ws}
    text = re.sub(r"(?i)n['’]t(?![0-9a-z\x80-\U0010ffff])", " not", text or "")
    parts = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), c)) for c in re.split(r"[.!?;:\n\r]", text)]
    words = [w.encode() for c in parts for w in c]
    total = 0.0
    for clause in parts:
        symbols = []
        for i, word in enumerate(clause):
            w, kind = word.encode(), classes.get(word)
            if kind:
                symbols.append((i, kind, 1.0))
                continue
            weight = t.FIXED_WEIGHT if word in tox.INSULTS else 0.0
            learned = model["words"].get(w)
            for n in sorted(tox.BEGINNINGS, reverse=True):
                if learned is None and len(w) >= n:
                    learned = model["beginnings"].get(w[:n])
            weight = max(weight, learned or 0.0)
            for n in tox.BEGINNINGS:
                if len(w) >= n and w[:n] in model["dense"]:
                    k = sum(x[:n] == w[:n] for x in words)
                    if k >= 2 and k * 128 >= len(words):
                        weight = max(weight, model["dense"][w[:n]])
            if weight:
                symbols.append((i, t.INSULT, weight))
        total += plain_clause(symbols)
    return total


def test_whole_fit_and_scores(spark, sf):
    """fit() and score() of a whole table, from counts over all labelled rows that are not held out."""
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{n}.parquet") for n in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    marks = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    first = {}
    for i in sorted(marks):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), texts[i] or ""))
        runs = [zlib.crc32(" ".join(w[k : k + 5]).encode()) for k in range(max(1, len(w) - 4))]
        first.setdefault((marks[i], min(runs)), i)
    prints = spark.createDataFrame([(p, i) for (_, p), i in first.items()], "print bigint, doc_id bigint")
    half = {r.doc_id: r.h for r in prints.select("doc_id", F.pmod(F.xxhash64("print"), F.lit(2)).alias("h")).collect()}
    count = defaultdict(lambda: [0, 0, 0, 0])  # toxic and all documents of half 0, of half 1
    sizes = [[0, 0], [0, 0]]
    own = {i: plain_terms(texts[i]) for i in half}
    for i, terms in own.items():
        sizes[half[i]][0] += marks[i]
        sizes[half[i]][1] += 1
        for x in terms:
            count[x][2 * half[i]] += marks[i]
            count[x][2 * half[i] + 1] += 1
    whole = [sizes[0][k] + sizes[1][k] for k in (0, 1)]
    base = whole[0] / whole[1]
    share = lambda a, n: (a + base) >= tox.LEAST_SHARE * (n + 1)
    strong = {x for x, (a, n, c, m) in count.items() if n + m >= 3 and a + c >= 3 and (share(a + c, n + m) or share(a, n) or share(c, m))}
    heads = {x[1 : 1 + min(tox.BEGINNINGS)] for x in strong if x[:1] == b"<" and tox.g2(count[x][0] + count[x][2], count[x][1] + count[x][3], *whole) >= tox.LEAST_G2}
    known = strong | {x for x, (_, n, _, m) in count.items() if n + m >= 3 and x[1 : 1 + min(tox.BEGINNINGS)] in heads}
    lexicons = [
        tox.lexicon_of([(x, count[x][0], count[x][1]) for x in known], *sizes[0]), tox.lexicon_of([(x, count[x][2], count[x][3]) for x in known], *sizes[1]),
        tox.lexicon_of([(x, count[x][0] + count[x][2], count[x][1] + count[x][3]) for x in known], *whole),
    ]
    held = [(half[i], sorted(own[i])) for i in own if marks[i]]
    lexicons = [tox.explained(lexicons[0], held, sizes[0][0], 0), tox.explained(lexicons[1], held, sizes[1][0], 1), tox.explained(lexicons[2], held, whole[0])]
    x = np.log1p([plain_evidence(texts[i], lexicons[1 - half[i]]) for i in own])
    y = np.array([marks[i] for i in own], float)
    a, b = tox.logistic(x, y)
    rest = y - 1 / (1 + np.exp(-(a + b * x)))
    assert abs(rest.sum() - (a - tox.DEFAULT[0])) < 1e-3 and abs((rest * x).sum() - (b - tox.DEFAULT[1])) < 1e-3  # the ridge's optimum
    model = tox.fit(docs, labels)
    assert {k: model[k] for k in ("words", "beginnings", "dense")} == lexicons[2]
    assert model["logistic"] == pytest.approx((a, b), abs=1e-4)
    got = {r.doc_id: r for r in tox.score(docs, model).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        want = 1 / (1 + math.exp(-(a + b * math.log1p(plain_evidence(text, lexicons[2])))))
        assert got[i].score == pytest.approx(want, abs=1e-4) and got[i].predicted == (got[i].score >= 0.3)


def test_sample_is_bounded_and_long_words_count(spark, monkeypatch):
    long = "z" * 90
    data = [(i, f"{long} common words here {i} a b c" if i % 5 == 0 else f"plain words stand here {i} d e f") for i in range(300)]
    docs = spark.createDataFrame(data, "doc_id int, text string")  # ids need not be longs
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in data], "doc_id int, toxic int")
    model = tox.fit(docs, labels)
    assert long.encode() in model["words"]
    assert Counter(r.predicted for r in tox.score(docs, model).collect()) == {1: 60, 0: 240}
    monkeypatch.setattr(tox, "SAMPLE_BYTES", 1000)
    assert 0 < sum(len(r.text) for r in tox.sample(docs, labels).collect()) <= 1000
