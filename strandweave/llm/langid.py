"""Language identification by rank-order n-gram profiles.

A language's profile is its PROFILE most frequent n-grams (1 to 4 letters of words with a
blank, written _, at both ends), in order.  A text's n-grams, as far as any profile has
them, are ranked by their counts over the whole text; the out-of-place distance to a
profile adds up, over the text's TOP most frequent n-grams, how far each one's place is from
its place in the profile, or PROFILE where the profile lacks it.  The nearest profile wins;
equal distances go to the language with more learned rows, then to the smaller name.  The
score is 1 - distance / greatest possible distance.  Equal counts are ordered by n-gram.

Words are those of the other operators in the lower-cased text, with their letters only.
N-grams of many texts are counted at once: letters are numbers, and a trie of all profiles'
n-grams, as a table of (node, letter), is followed from every place of the texts in step.

Profiles are fitted on whole texts of at most SAMPLE_DOCS documents a language, those with
the least hashes of id and text; rows that agree in both count once.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is
everything if there is no row to learn from; letters that no profile has give the
language with most rows and score 0; null ids are never held out; rows that repeat an id
are judged each; ids come out as longs; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BYTES, held_out, python_table, scratch

GRAMS = 4
PROFILE = 400
TOP = 300
SAMPLE_DOCS = 2_000
MAX_LANGUAGES = 1_000
#: Characters, and texts, that are judged at once.
CHUNK, TEXTS = 1 << 18, 256

BLANK = ord("_")
_KIND: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Of each code point: 0 parts words, 1 is left out of its word, 2 is a letter."""
    if not _KIND:
        kind = np.fromiter((2 if chr(c).isalpha() else 1 for c in range(0x110000)), np.uint8, 0x110000)
        kind[:128] = [0 if WORD_BYTES[c] == 0x20 else k for c, k in enumerate(kind[:128])]
        _KIND.append(kind)
    return _KIND[0]


def tape(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(letters of all texts with one blank before, between and after words; where each text begins, and the end)."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds()[points]
    starts = np.cumsum([0, *(len(t) + 1 for t in lowered)])
    here = kind != 1
    blank = kind[here] == 0
    keep = ~blank
    keep[-1] = True
    keep[:-1] |= ~blank[1:]  # of blanks in a row the last, which belongs to the text that follows
    places = np.flatnonzero(here)[keep]
    out = np.where(kind[places] == 2, points[places], BLANK)
    return out, np.searchsorted(places, starts)


def grams_of(word: str) -> list[str]:
    w = f"_{word}_"
    return [w[i : i + n] for n in range(1, GRAMS + 1) for i in range(len(w) - n + 1) if w[i : i + n] != "_"]


def fit(docs: DataFrame) -> list[tuple[str, int, list[str]]]:
    """(language, rows, n-grams by rank), languages with more rows first."""
    with scratch(docs.sparkSession):
        return _fit(docs)


def _fit(docs: DataFrame) -> list[tuple[str, int, list[str]]]:
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = sorted(((r[0], r[1]) for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()), key=lambda r: (-r[1], r[0]))
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    if not sizes:
        return []
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    share = F.lit(0)
    for lang, n in sizes:
        share = F.when(F.col("lang") == lang, F.lit(int(min(1.0, 1.2 * SAMPLE_DOCS / n) * (1 << 30)))).otherwise(share)
    few = rows.filter(F.pmod("h", F.lit(1 << 30)) <= share).groupBy("lang", "doc_id", "h").agg(F.min("text").alias("text"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h", "doc_id"))
    few = few.withColumn("k", order).filter(F.col("k") <= SAMPLE_DOCS).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for b in batches:
            for lang, text in zip(*b.columns, strict=True):
                by = counts.setdefault(lang.as_py(), Counter())
                letters, _ = tape([text.as_py()])
                for word, k in Counter(letters.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").split("_")).items():
                    if word:
                        for g in grams_of(word):
                            by[g] += k
        for lang, by in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(by)), pa.array(list(by)), pa.array(list(by.values()), pa.int64())], names=["lang", "gram", "n"])

    sums = python_table(few.mapInArrow(run, "lang string, gram string, n bigint"), "grams").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best: dict = {}
    for r in sums.withColumn("r", rank).filter(F.col("r") <= PROFILE).collect():
        best.setdefault(r.lang, []).append((r.r, r.gram))
    return [(lang, n, [g for _, g in sorted(best.get(lang, []))]) for lang, n in sizes]


class Judge:
    """Out-of-place distances to profiles."""

    def __init__(self, profiles: list[tuple[str, int, list[str]]]):
        self.names = [p[0] for p in profiles]
        grams = sorted({g for p in profiles for g in p[2]})
        index = {g: i for i, g in enumerate(grams)}
        self.n = len(grams)
        self.place = np.full((len(profiles), self.n), -1, np.int32)
        for k, p in enumerate(profiles):
            for r, g in enumerate(p[2]):
                self.place[k, index[g]] = r
        # Letters are numbers from 1, 0 stands for all that no profile has; node 0 is where no n-gram goes on, 1 the root.
        points = sorted({ord(c) for g in grams for c in g})
        self.number = np.zeros(0x110000, np.uint16)
        self.number[points] = np.arange(1, len(points) + 1)
        wide, step, gram = len(points) + 1, {}, {}
        nodes = 2
        for g in grams:
            at = 1
            for c in g:
                key = at, int(self.number[ord(c)])
                if key not in step:
                    step[key] = nodes
                    nodes += 1
                at = step[key]
            gram[at] = index[g]
        self.step = np.zeros((nodes, wide), np.int32)
        for (at, c), to in step.items():
            self.step[at, c] = to
        self.gram = np.full(nodes, -1, np.int32)
        for at, i in gram.items():
            self.gram[at] = i

    def __call__(self, text: str | None) -> tuple[str, float]:
        return self.judge([text])[0]

    def judge(self, texts: list[str | None]) -> list[tuple[str, float]]:
        letters, starts = tape(texts)
        own = np.diff(np.searchsorted(np.flatnonzero(letters != BLANK), starts)) > 0
        if not self.names:
            return [("und", 0.0)] * len(texts)
        if not self.n:
            return [(self.names[0], 0.0) if o else ("und", 0.0) for o in own]
        doc = np.repeat(np.arange(len(texts)), np.diff(starts))
        c = self.number[letters[: starts[-1] + 1]]
        cells, node = [], np.ones(len(c), np.int32)
        for k in range(GRAMS):
            node = self.step[node[: len(c) - k], c[k:]]
            at = np.flatnonzero(self.gram[node[: len(doc)]] >= 0)
            cells.append(doc[at] * self.n + self.gram[node[at]])
        count = np.bincount(np.concatenate(cells), minlength=len(texts) * self.n).reshape(len(texts), self.n)
        # Larger counts first, of equal ones the n-gram that comes first: one number that orders both.
        order = np.sort(-(count * self.n + np.arange(self.n - 1, -1, -1)), axis=1)[:, :TOP]
        taken = -order >= self.n  # a count of at least one
        gram = self.n - 1 + order % -self.n
        far = np.empty((len(self.names), len(texts)), np.int64)
        for k, place in enumerate(self.place[:, gram]):
            far[k] = (np.where(place < 0, PROFILE, np.abs(place - np.arange(gram.shape[1]))) * taken).sum(1)
        n, best = taken.sum(1), far.argmin(0)
        least = far[best, np.arange(len(texts))]
        return [
            ("und", 0.0) if not o else (self.names[0], 0.0) if not m else (self.names[b], max(0.0, 1.0 - d / (PROFILE * m)))
            for o, m, b, d in zip(own.tolist(), n.tolist(), best.tolist(), least.tolist(), strict=True)
        ]


def predict(docs: DataFrame, profiles: list[tuple[str, int, list[str]]]) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for b in batches:
            out, texts, held = [], [], 0
            for t in b.column(2):
                texts.append(t.as_py())
                held += len(texts[-1] or "")
                if held >= CHUNK or len(texts) >= TEXTS:
                    out += judge.judge(texts)
                    texts, held = [], 0
            if texts:
                out += judge.judge(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return python_table(rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double"), "languages")
