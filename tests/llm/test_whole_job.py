"""Results at the borders where operators could do less than the whole job."""

import pytest

from strandweave.llm import decontam, minhash, topk, toxicity


def test_blocks_of_unlinked_nodes(spark, monkeypatch):
    """A bucket without links is dealt in small groups, and all its pairs meet once."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    n = 120
    open_ = spark.createDataFrame([(7, i, 8, 0) for i in range(n)], "bucket bigint, id bigint, blocks int, block int")
    label = spark.createDataFrame([(3, 3), (4, 3)], "id bigint, label bigint")
    groups: dict = {}
    for r in minhash._open_rows(open_, label).collect():
        groups.setdefault((r.bucket, r.at), []).append(r)
    assert max(map(len, groups.values())) <= 5 * 16
    met = sorted((x.id, y.id) for g in groups.values() for x in g if x.outside for y in g if y.home)
    assert met == sorted((x, y) for x in range(n) if x not in (3, 4) for y in range(n))


def test_texts_that_share_an_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    data = [(1, a), (1, b), (1, b), (2, b + " end"), (3, c), (None, c), (4, None), (4, "")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    got = [tuple(r) for r in minhash.classes(docs).select("doc_id", "class_id").collect()]
    # Every text of an id has a row; the copies b and b + " end" are one class, a is not in it.
    assert sorted(i for i, _ in got) == [1, 1, 2, 3, 4, 4] and len({k for _, k in got}) == 5
    assert {k for i, k in got if i == 2} < {k for i, k in got if i == 1}
    kept = [tuple(r) for r in minhash.deduplicate(docs).collect()]
    texts = [t for _, t in kept]
    assert len(kept) == 6 and {a, c, None, ""} <= set(texts) and texts.count(c) == 2 and (b in texts) != (b + " end" in texts)


def test_contracted_negations():
    lex = toxicity.Lexicon({}, {})
    plain = toxicity.FIXED_WEIGHT * toxicity.NEGATED
    for text in ("you are not an idiot", "you aren't an idiot", "You AREN’T an idiot", "you don't look an idiot"):
        assert toxicity.evidence(text, lex) == pytest.approx(plain)
    assert toxicity.evidence("you can'tx idiot", lex) == toxicity.evidence("you idiot", lex)


def brute_top(data, k=20):
    """Exact top-k in Python integers; (query_id, score, vec_id) of each query row, ranked."""
    import math

    ints = [(i, [math.floor(x * 64) if abs(x) < 2**53 else int(x) * 64 for x in v]) for i, v in data]
    out = []
    for n, (q, v) in enumerate(ints):
        if q % 20 == 0:
            s = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), c) for m, (c, w) in enumerate(ints) if m != n)[:k]
            out += [(q, r, c, max(-(2**63), min(2**63 - 1, -x))) for r, (x, c) in enumerate(s, 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [1.0, 2.0**25, 2.0**29, 1e30, 1e300, 1.7e308])
def test_topk_is_exact_at_every_size(spark, monkeypatch, size):
    import random

    rnd = random.Random(3)
    monkeypatch.setattr(topk, "SHARD_ROWS", 30)  # several shards
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    data = [(i, [rnd.choice((-1, 1)) * size + rnd.randrange(-3, 4) / 64 for _ in range(3)]) for i in range(100)]
    data += [(20, data[20][1]), (20, data[20][1]), (41, data[40][1]), (60, [size, size + 1 / 64, 0.0])]  # repeated ids, rows and ties
    frame = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    assert sorted(map(tuple, topk.divisible(frame).collect())) == brute_top(data)


def test_topk_takes_no_settings(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    topk.divisible(spark.createDataFrame([(20, [1.0]), (1, [1.0])], "vec_id bigint, embedding array<double>"))
    assert spark.conf.get(name, None) == before


def test_decontamination_over_blocks_and_null_ids(spark):
    """Items over many blocks are judged as in one; a null id counts, without a name."""
    import hashlib

    a, b, c = (" ".join(f"{x}{k}" for k in range(20)) for x in "abc")
    items = [("i1", a), (None, b), ("i2", c), ("i2", a[:30]), (None, "a0"), ("z", " ".join(["the"] * 30)), ("y", "the the the")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = spark.createDataFrame([(1, a + " x " + b), (2, b), (2, c), (3, "w " * 300 + b), (4, None), (None, a), (5, "the " * 14), (5, "the " * 14), (6, "a0")], "doc_id bigint, text string")
    got = sorted(map(tuple, decontam.digest(docs, bench).collect()), key=repr)
    for size in (10, 200):
        assert sorted(map(tuple, decontam.digest(docs, bench, size).collect()), key=repr) == got
        assert sorted(map(tuple, decontam.clean(docs, bench, size).collect()), key=repr) == sorted(map(tuple, decontam.clean(docs, bench).collect()), key=repr)
    by = {r[0]: r for r in got if r[0] in (1, 3, 5, 6)}
    sha = lambda *names: hashlib.sha256(",".join(names).encode()).hexdigest()
    assert by[1][1:] == (41, 40, 3, sha("i1", "i2"), True)  # i1, the short item i2 and the one without id
    assert by[3][1:] == (320, 20, 1, sha(), True) and by[5][1:] == (14, 14, 2, sha("y", "z"), True) and by[6][3] == 1


def test_decontamination_tables_are_small():
    import random

    rnd = random.Random(1)
    vocabulary = [f"word{int(rnd.paretovariate(0.6)) % 30_000}" for _ in range(170_000)]
    tables = decontam.Searcher([(k, " ".join(vocabulary[k : k + 500])) for k in range(0, 170_000, 500)])
    assert tables.bytes() < 40 * 170_000
    text = " ".join(vocabulary[1000:1100])
    assert len(tables(text)[1]) == 100 and tables(text)[2] >= {"1000"}


def test_null_ids_are_documents_on_request(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    docs = spark.createDataFrame([(None, a), (None, a), (None, b), (1, a + " end"), (2, None), (None, None), (None, "")], "doc_id bigint, text string")
    got = [tuple(r) for r in minhash.classes(docs, null_ids=True).select("doc_id", "class_id").collect()]
    assert len(got) == 6 and sum(k == 1 for _, k in got) == 2 and len({k for _, k in got}) == 5
    kept = [tuple(r) for r in minhash.deduplicate(docs, null_ids=True).collect()]
    assert sorted(kept, key=repr) == sorted([(None, b), (1, a + " end"), (2, None), (None, None), (None, "")], key=repr)
    assert len(minhash.classes(docs).collect()) == 2


def test_word_hashes_of_long_texts(monkeypatch):
    import numpy as np

    texts = ["one two " * 50, "x" * 300 + " tail", None, "", "one two"]
    whole = minhash.word_hashes(texts)
    monkeypatch.setattr(minhash, "CHUNK_BYTES", 64)  # parts of long texts
    small = minhash.word_hashes(texts)
    assert all(np.array_equal(x, y) for x, y in zip(whole, small, strict=True))
    assert whole[1].tolist() == [100, 2, 0, 0, 2] and whole[0][0] == whole[0][-2]


def test_mixing_borders_by_any_number_of_digits(spark, docs, monkeypatch):
    from strandweave.llm import mixing, registry

    picked = lambda: sorted((r.doc_id, r.copies, r.partial_tokens) for r in mixing.selection(*mixing.plan(docs, registry.MIX), registry.MIX).collect())
    want = picked()
    monkeypatch.setattr(mixing, "LEAST_DIGITS", 1)
    assert picked() == want
    monkeypatch.setattr(mixing, "RANGE_ROWS", 0.01)  # more ranges than rows
    assert picked() == want


def test_languages_of_many_texts_at_once():
    """Texts that are judged together get what each gets alone, and what plain counting gives."""
    import random
    from collections import Counter

    from strandweave.llm import langid

    from .test_operators import plain_words

    rnd = random.Random(7)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 7)))
    texts = [" ".join(word(rnd.choice(("abcé", "bcdß", "xyz1.,_ "))) for _ in range(rnd.randint(0, 40))) + rnd.choice(("", ".", " ", "!? ")) for _ in range(200)]
    texts += [None, "", "123", "中", "İSTANBUL", "a", "..a..", "\n", "ΑΣ", "x" * 5000]

    def grams(text):
        out = Counter()
        for w in plain_words((text or "").lower()):
            w = "".join(c for c in w if c.isalpha())
            if w:
                out.update(langid.grams_of(w))
        return out

    profiles = []
    for lang, own in (("p", texts[:50]), ("q", texts[50:90])):
        total = sum((grams(t) for t in own), Counter())
        profiles.append((lang, len(own), [g for g, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[: langid.PROFILE]]))
    judge = langid.Judge(profiles)
    known = {g for p in profiles for g in p[2]}

    def plain(text):
        count = grams(text)
        if not count:
            return "und", 0.0
        top = [g for g, _ in sorted(((g, n) for g, n in count.items() if g in known), key=lambda x: (-x[1], x[0]))[: langid.TOP]]
        if not top:
            return "p", 0.0
        far = [sum(abs(p[2].index(g) - k) if g in p[2] else langid.PROFILE for k, g in enumerate(top)) for p in profiles]
        return profiles[far.index(min(far))][0], max(0.0, 1 - min(far) / (langid.PROFILE * len(top)))

    together = judge.judge(texts)
    assert together == [judge(t) for t in texts] == [plain(t) for t in texts]


def test_token_files_with_any_tokenizer(spark, tmp_path):
    """The fast way is taken for the tokenizer it is right for; ids are the library's with both."""
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from strandweave.llm import tokenbin

    texts = ["Hello, World. it's  FINE\n\ttabs", None, "", "<|endoftext|> x", "naïve Straße 中文   ́a", "x." * 50]
    data = [(i, t) for i, t in enumerate(texts)] + [(7, "same")] * 40 + [(None, "none")] * 20
    docs = spark.createDataFrame(data, "doc_id int, text string").repartition(3)
    for k, name in enumerate(("word_bpe_49k.json", "byte_bpe_50k.json")):
        path = public_tokenizers.path(name)
        assert tokenbin.in_pieces(path) == (k == 0)
        tokenbin.write(docs, path, f"{tmp_path}/{k}")
        got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in tokenbin.read(spark, f"{tmp_path}/{k}").collect()))
        own, want, start = Tokenizer.from_file(path), [], 0
        for i, t in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0)):
            ids = own.encode(t or "", add_special_tokens=False).ids + [1]
            want.append((i is not None, i or 0, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert got == want
