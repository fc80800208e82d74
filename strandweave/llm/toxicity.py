"""Toxicity by a weighted finite-state grammar over clauses.

A text is cut into clauses at . ! ? ; : and line ends; a contracted n't is the word not.  The
lexicon rewrites words to weighted symbols: insult, threat, target, negation, report or other.
Transducers (``transducer``) read the symbols, each with states of its own, and are composed:
  * negation: an insult or threat within NEAR symbols after a negation keeps NEGATED of its weight;
  * reported speech: after a reporting word, what follows in the clause keeps REPORTED;
  * target: an insult within NEAR symbols of a target, before or after it, gets TARGETED times its
    weight; a threat counts only with a target in its clause.
The first three read a clause forwards as one composed transducer; the target's, composed with
what each symbol is worth, reads what they wrote backwards.  A clause's score is the sum of
the products; clauses without an insult or threat have none.  A document's evidence is the sum
of its clauses' scores, its score a logistic function of log(1 + evidence).

Insults are the fixed words below and terms that labelled documents show: words, beginnings of
words, and beginnings that a document is dense in (at least DENSE words start so, and one of
DENSE_IN).  A term's presence in toxic is held against that in other documents; it is kept if
the likelihood ratio is at least LEAST_G2 and at least LEAST_SHARE of the documents that hold it
are toxic (smoothed); weight: the smoothed log odds.  Of labelled documents that share their
least five-word run only one counts, and terms that stand only beside more common insults are
left out, so that copies of a toxic document don't make its other words insults.  A longer
beginning or whole word that is known not to be toxic clears what a shorter beginning says.

The lexicon and the logistic function are fitted on a bounded sample of labelled documents
that are not held out: those with the least hashes, at most SAMPLE_DOCS, and of them as many
as come to SAMPLE_BYTES of text; the function on evidence by lexicons of the other half of them.
What the driver collects is terms and labels of this sample; no term of it is left out by its
length or number.

Defined results: null, empty and wordless texts have no evidence and the score of that;
labels other than 0 and 1 and null ids are not learned from; several labels of an id count
as the greatest; without labels the fixed words and DEFAULT decide; rows that repeat an id
are judged each; ids come out as longs; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BYTES, held_out, materialize, python_table, scratch, trim, trimmed
from .transducer import FIXED_WEIGHT, INSULT, NEGATED, NEGATION, OTHER, REPORT, REPORTED, TARGET, TARGETED, THREAT, Grammar

# Words of the grammar's classes.
INSULTS = "arschloch bastard cabrón clown connard crétin depp disgusting dummkopf estúpido filth idiot idiota idiote idioten imbécile imbécil loser losers moron morons pathetic salaud scum stupid trash trottel vermin worthless".split()
THREATS = "beat burn destroy hang hurt kill murder shoot stab strangle destruir matar matarte tuer détruire frapper töten umbringen schlagen vernichten".split()
TARGETS = "you your you're u he she they them him her tu te toi vous ton ta votre ihr dich dir du sie euch dein deine tú ti usted ustedes vos él ella ellos".split()
NEGATIONS = "not no never isn't aren't don't doesn't nor ne pas jamais non kein keine keinen nicht nie niemals nunca jamás ni".split()
REPORTS = "said says saying told quote quoted wrote called calls dit disait écrit cité sagte sagt schrieb zitiert dijo dice escribió citó".split()

SAMPLE_DOCS = 20_000
SAMPLE_BYTES = 128 << 20
BEGINNINGS = (4, 5, 6)  # bytes
LEAST_G2 = 24.0
LEAST_SHARE = 0.7
#: A document is dense in a beginning that at least DENSE of its words have, and at least one of DENSE_IN of them.
DENSE, DENSE_IN = 2, 128
#: Terms of a task that are counted in memory at once.
HELD_TERMS = 200_000
COMMON, MANY, NEW = 0.01, 25, 2
DEFAULT = (-3.0, 3.0)
THRESHOLD = 0.3
MAX_WORDS = 100_000

#: As WORD_BYTES, but clause ends become line feeds.
CLAUSE_BYTES = bytes(0x0A if b in b".!?;:\n\r" else WORD_BYTES[b] for b in range(256))

#: The contracted negation, with either apostrophe; read as the word "not".
CONTRACTED = re.compile(rb"n(?:'|\xe2\x80\x99)t(?![0-9a-z\x80-\xff])", re.IGNORECASE)


class Lexicon(dict):
    """Word to (class, weight, dense beginnings), or None; learned words and beginnings before fixed ones."""

    def __init__(self, words: dict[bytes, float], beginnings: dict[bytes, float], dense: dict[bytes, float] | None = None):
        super().__init__()
        self.words, self.beginnings, self.dense = words, beginnings, dense or {}
        self.fixed = {w.encode(): (k, 1.0) for k, ws in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS)) for w in ws}
        self.fixed |= {w.encode(): (INSULT, FIXED_WEIGHT) for w in INSULTS}

    def __missing__(self, word: bytes):
        if len(self) > MAX_WORDS:
            self.clear()
        kind, own = self.fixed.get(word, (OTHER, 0.0))
        dense = ()
        if kind in (OTHER, INSULT):
            weight = self.words.get(word)
            for n in reversed(BEGINNINGS):  # the most specific term that is known decides
                if weight is None and len(word) >= n:
                    weight = self.beginnings.get(word[:n])
            if weight:
                kind, own = INSULT, max(weight, own)
            dense = tuple(word[:n] for n in BEGINNINGS if len(word) >= n and word[:n] in self.dense)
        found = (kind, own, dense) if kind or dense else None
        self[word] = found
        return found


GRAMMAR = Grammar()
clause_score = GRAMMAR


def clauses(text: str | None) -> list[list[bytes]]:
    """The words of each clause."""
    if not text:
        return []
    raw = text.encode()
    if b"'" in raw or b"\xe2\x80\x99" in raw:
        raw = CONTRACTED.sub(b" not", raw)
    return [c.split() for c in raw.translate(CLAUSE_BYTES).split(b"\n")]


def evidence(text: str | None, lexicon: Lexicon, grammar: Grammar = GRAMMAR) -> float:
    get, n, held, count = lexicon.__getitem__, 0, [], Counter()
    for words in clauses(text):
        n += len(words)
        found = list(map(get, words))
        if any(found):
            symbols = [(i, *s) for i, s in enumerate(found) if s]
            if any(s[1] in (INSULT, THREAT) or s[3] for s in symbols):
                held.append(symbols)
                for s in symbols:
                    count.update(s[3])
    full = {k for k, c in count.items() if c >= DENSE and c * DENSE_IN >= n}
    total = 0.0
    for symbols in held:
        tape = []
        for i, kind, weight, dense in symbols:
            if full and dense:
                most = max((lexicon.dense[k] for k in dense if k in full), default=0.0)
                if most > weight:
                    kind, weight = INSULT, most
            if kind:
                tape.append((i, kind, weight))
        if any(k in (INSULT, THREAT) for _, k, _ in tape):
            total += grammar(tape)
    return total


def terms_of(text: str | None) -> set[bytes]:
    """=word, <beginning and, where a text is dense in it, +beginning."""
    words = (text or "").encode().translate(WORD_BYTES).split()
    starts = Counter(w[:n] for w in words for n in BEGINNINGS if len(w) >= n)
    return {b"=" + w for w in words} | {b"<" + b for b in starts} | {b"+" + b for b, c in starts.items() if c >= DENSE and c * DENSE_IN >= len(words)}


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(intercept, slope) by damped Newton steps, with a ridge towards DEFAULT."""
    at, goal = np.array(DEFAULT), np.array(DEFAULT)
    rows = np.stack([np.ones_like(x), x], 1)

    def loss(c: np.ndarray) -> float:
        z = rows @ c
        return float((np.logaddexp(0, z) - y * z).sum() + ((c - goal) ** 2).sum() / 2)

    now = loss(at)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(rows @ at, -500, 500)))
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + np.eye(2), rows.T @ (p - y) + at - goal)
        size = 1.0
        while size > 1e-6 and loss(at - size * step) > now:
            size /= 2
        if size <= 1e-6 or now - loss(at - size * step) < 1e-9:
            break
        at = at - size * step
        now = loss(at)
    return float(at[0]), float(max(at[1], 0.0))


def g2(t: int, n: int, toxic: int, total: int) -> float:
    """Likelihood ratio of t toxic among n documents with a term."""

    def part(k: int, m: int, p: float) -> float:
        return (k * math.log(p) if k else 0.0) + ((m - k) * math.log(1 - p) if m > k else 0.0)

    if not 0 < toxic < total or n in (0, total):
        return 0.0
    p1, p2, p = t / n, (toxic - t) / (total - n), toxic / total
    return 2 * (part(t, n, p1 or 1e-12) + part(toxic - t, total - n, p2 or 1e-12) - part(t, n, p) - part(toxic - t, total - n, p)) if p1 > p else 0.0


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, half, doc_id) of the labelled documents to learn from."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = int(min(1.0, 1.1 * SAMPLE_DOCS / max(1, known.count())) * (1 << 30))
    few = known.filter(h <= share).orderBy(h, "doc_id").limit(SAMPLE_DOCS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"), "doc_id")
    rows = python_table(rows.mapInArrow(trimmed(_prints), "text string, toxic int, doc_id bigint, print bigint"), "toxic-rows")
    # Copies would make every word of theirs look toxic: one document stays of those that share a print.
    rows = rows.groupBy("toxic", "print").agg(F.min_by(F.struct("text", "doc_id"), F.struct("doc_id", F.xxhash64("text"))).alias("r"))
    rows = materialize(rows.select("r.text", "toxic", F.pmod(F.xxhash64("print"), F.lit(2)).cast("int").alias("half"), "r.doc_id", "print"), "toxic-sample")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    if (rows.agg(F.sum(size)).first()[0] or 0) <= SAMPLE_BYTES:
        return rows
    # At most SAMPLE_DOCS rows: one task orders them.
    upto = F.sum("size").over(Window.orderBy(h, "toxic", "print"))
    kept = rows.select("doc_id", "toxic", "print", size.alias("size")).withColumn("upto", upto).filter(F.col("upto") <= SAMPLE_BYTES)
    return materialize(rows.join(F.broadcast(kept.select("toxic", "print")), ["toxic", "print"]).select(*rows.columns), "toxic-sample")


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least hash of a text's five-word runs: near copies mostly share it."""
    for b in batches:
        out = []
        for t in b.column(0):
            w = (t.as_py() or "").encode().translate(WORD_BYTES).split()
            out.append(min((zlib.crc32(b" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))), default=0))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*b.schema.names, "print"])


KINDS = {b"=": "words", b"<": "beginnings", b"+": "dense"}


def lexicon_of(terms: list[tuple[bytes, int, int]], toxic: int, total: int) -> dict:
    """Weights of words and beginnings from (term, toxic documents, documents); 0 for terms that clear what a shorter beginning says."""
    base = toxic / max(1, total)
    out: dict = {"words": {}, "beginnings": {}, "dense": {}}
    for term, t, n in terms:
        p = (t + base) / (n + 1)
        held = out[KINDS[term[:1]]]
        if p >= LEAST_SHARE:
            if t >= 3 and g2(t, n, toxic, total) >= LEAST_G2:
                held[term[1:]] = math.log(p / (1 - p)) - math.log(base / (1 - base))
        elif n >= 3 and term[:1] != b"+":
            held[term[1:]] = 0.0
    return out


def explained(lexicon: dict, held: list[tuple[int, list[bytes]]], toxic: int, half: int | None = None) -> dict:
    """The lexicon without words that are only found beside stronger ones.

    Terms are taken by falling count; a rarer one than COMMON of the toxic documents (or
    MANY of them) stays only if at least NEW documents have none of those before it.
    held: (half, terms) of each toxic document.
    """
    at: dict[bytes, set] = {}
    for k, (h, terms) in enumerate(held):
        if half is None or h == half:
            for t in terms:
                at.setdefault(t, set()).add(k)
    covered: set = set()
    out = {kind: {k: v for k, v in lexicon[kind].items() if not v} for kind in KINDS.values()}
    strong = [(mark + k, v, kind) for mark, kind in KINDS.items() for k, v in lexicon[kind].items() if v]
    # Of equal counts words come before beginnings and longer before shorter.
    for term, v, kind in sorted(strong, key=lambda r: (-len(at.get(r[0], ())), b"=+<".index(r[0][:1]), -len(r[0]), r[0])):
        own = at.get(term, set())
        if len(own) >= max(MANY, COMMON * toxic) or len(own - covered) >= NEW:
            out[kind][term[1:]] = v
            covered |= own
    return out


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The lexicon of all sampled rows; the logistic function of evidence by lexicons of the other half."""
    with scratch(docs.sparkSession):
        return _fit(docs, labels)


def _fit(docs: DataFrame, labels: DataFrame) -> dict:
    rows = sample(docs, labels).select("text", "toxic", "half")
    sizes = {(r[0], r[1]): r[2] for r in rows.groupBy("half", "toxic").count().collect()}
    toxic = [sizes.get((h, 1), 0) for h in (0, 1)]
    total = [toxic[h] + sizes.get((h, 0), 0) for h in (0, 1)]
    model = {"words": {}, "beginnings": {}, "dense": {}, "logistic": DEFAULT}
    if not 0 < sum(toxic) < sum(total):
        return model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {(h, y): Counter() for h in (0, 1) for y in (0, 1)}

        def counted() -> Iterator[pa.RecordBatch]:
            for (h, y), count in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array([h] * len(count), pa.int32()), pa.array([y] * len(count), pa.int32()), pa.array(list(count.values()), pa.int64())], names=["term", "half", "toxic", "n"])
                count.clear()

        for b in batches:
            for text, y, h in zip(*b.columns, strict=True):
                seen[h.as_py(), y.as_py()].update(terms_of(text.as_py()))
                if sum(map(len, seen.values())) > HELD_TERMS:
                    yield from counted()
        yield from counted()

    part = lambda h, y: F.sum(F.when((F.col("half") == h) & (F.col("toxic") >= y), F.col("n")).otherwise(0))
    sums = rows.mapInArrow(trimmed(run), "term binary, half int, toxic int, n bigint").groupBy("term").agg(part(0, 1).alias("t0"), part(0, 0).alias("n0"), part(1, 1).alias("t1"), part(1, 0).alias("n1"))
    sums = python_table(sums.filter(F.col("n0") + F.col("n1") >= 3), "toxic-terms")
    base = sum(toxic) / sum(total)

    def share(t, n):
        return t + base >= LEAST_SHARE * (n + 1)

    t, n = F.col("t0") + F.col("t1"), F.col("n0") + F.col("n1")
    strong = sums.filter((t >= 3) & (share(t, n) | share(F.col("t0"), F.col("n0")) | share(F.col("t1"), F.col("n1")))).collect()
    # What extends a strong beginning without being toxic itself clears it.
    heads = sorted({bytes(r.term[1 : 1 + BEGINNINGS[0]]) for r in strong if r.term[:1] == b"<" and g2(r.t0 + r.t1, r.n0 + r.n1, sum(toxic), sum(total)) >= LEAST_G2})
    known = {bytes(r.term): (r.t0, r.n0, r.t1, r.n1) for r in strong}
    if heads:
        listed = docs.sparkSession.createDataFrame([(h,) for h in heads], "head binary")
        near = sums.withColumn("head", F.substring("term", 2, BEGINNINGS[0])).join(listed, "head")
        known |= {bytes(r.term): (r.t0, r.n0, r.t1, r.n1) for r in near.collect()}
    lexicons = [
        lexicon_of([(k, a, m) for k, (a, m, _, _) in known.items()], toxic[0], total[0]),
        lexicon_of([(k, a, m) for k, (_, _, a, m) in known.items()], toxic[1], total[1]),
        lexicon_of([(k, a + c, m + o) for k, (a, m, c, o) in known.items()], sum(toxic), sum(total)),
    ]
    wanted = docs.sparkSession.sparkContext.broadcast({mark + k for lex in lexicons for mark, kind in KINDS.items() for k, v in lex[kind].items() if v})

    def holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [sorted(terms_of(t.as_py()) & wanted.value) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(terms, pa.list_(pa.binary()))], names=["half", "terms"])

    bad = rows.filter("toxic = 1").select("text", "half").mapInArrow(holds, "half int, terms array<binary>")
    held = [(r[0], [bytes(t) for t in r[1]]) for r in python_table(bad, "toxic-held").collect()]
    lexicons = [explained(lexicons[0], held, toxic[0], 0), explained(lexicons[1], held, toxic[1], 1), explained(lexicons[2], held, sum(toxic))]
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = [Lexicon(**shared.value[1]), Lexicon(**shared.value[0])]
        for b in batches:
            x = [evidence(text.as_py(), other[h.as_py()]) for text, h in zip(b.column(0), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), b.column(1)], names=["x", "y"])

    pairs = sorted((r[0], r[1]) for r in python_table(rows.mapInArrow(found, "x double, y int"), "toxic-evidence").collect())
    return lexicons[2] | {"logistic": logistic(np.log1p([x for x, _ in pairs]), np.array([y for _, y in pairs], float))}


class Scorer:
    def __init__(self, model: dict, grammar: Grammar = GRAMMAR):
        self.lexicon, (self.a, self.b) = Lexicon(model["words"], model["beginnings"], model["dense"]), model["logistic"]
        self.grammar = grammar

    def __call__(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-(self.a + self.b * math.log1p(evidence(text, self.lexicon, self.grammar)))))


def _scores(docs: DataFrame, model: dict, without: frozenset[str] = frozenset()):
    """A function of a text column: its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value, Grammar(without))
        for texts in parts:
            yield pa.array([scorer(t.as_py()) for t in texts], pa.float64())
        trim()

    return scores


def score(docs: DataFrame, model: dict, without: frozenset[str] = frozenset()) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), _scores(docs, model, without)("text").alias("score"))
    return python_table(rows, "toxicity").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def clean(docs: DataFrame, model: dict) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns; only texts go to Python."""
    return docs.filter(_scores(docs, model)("text") < THRESHOLD)
