"""Benchmark decontamination by Wu-Manber search for many word patterns.

Patterns are the 13-word windows of every benchmark item, or the whole item where it
is shorter.  The alphabet is the words that items hold, as numbers; a document's other
words are none of them.  Patterns of one length m form a searcher with
  * a shift table: for each block of B words (2; 1 where m is 1) that ends in some
    pattern at word j, the distance m - j to the pattern's end; a block that is in no
    pattern allows a shift of m - B + 1, so most positions are passed over;
  * suffix buckets: patterns by their last block (shift 0), inside a bucket in the order of
    a hash of the whole pattern, so that a common block does not mean a long search, and
  * a direct comparison of the patterns found so with the words that end there.
Items are kept as one array of word numbers and patterns as places in it: about 30 bytes a
word and the vocabulary, whatever the items share; 16 MB of text took 54 MB of arrays, a block takes half of that.

Benchmark items are searched in blocks of at most MAX_BLOCK_BYTES of text each, so that
what is broadcast, and the tables that each worker process builds from it once, have a
fixed bound.  One block needs one narrow pass over the documents; only texts go to Python.
Of more blocks, each makes a pass that gives a row for a text with hits alone, by the text's
hash, and those rows are joined by it; no pass writes the documents.

Defined results: null texts have no words; items without words have no window; items
that repeat an id count as one item, a null id counts as an item but its name is no part of
``items`` (and of items_sha256); rows that repeat a doc_id are judged each on its own text;
empty tables give no rows or no hits; other columns play no part.
"""

from __future__ import annotations

import hashlib
import pickle
from array import array
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import python_table, trim, words_of

WINDOW = 13
MAX_BLOCK_BYTES = 8 << 20
#: Characters that are searched at once.
CHUNK = 1 << 18

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a pattern's hash that order a bucket; the others number the bucket.
_HASH_BITS = np.uint64(36)
_BUILT: dict[str, "Searcher"] = {}


class Length:
    """Shift table and buckets of the patterns of m words."""

    def __init__(self, m: int, ids: np.ndarray, first: np.ndarray, last: np.ndarray, base: int):
        """ids: all items' words; first, last: where the items of this length begin and end in it; base: a number above all words."""
        self.m, self.block, self.base = m, min(2, m), base
        self.most = m - self.block + 1
        sizes = last - first - self.block + 1  # blocks of each item
        offset = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.repeat(first, sizes) + offset
        keys = self.keys(ids)[at]
        shift = np.maximum(0, m - self.block - offset)
        order = np.lexsort((shift, keys))
        self.known, head = np.unique(keys[order], return_index=True)
        self.shift = shift[order][head].astype(np.int8)
        ends = shift == 0
        self.start = (at[ends] - (m - self.block)).astype(np.int32)
        mixed = self.mixed(np.searchsorted(self.known, keys[ends]), ids, self.start)
        order = np.argsort(mixed, kind="stable")
        self.start, self.bucket = self.start[order], mixed[order]

    def keys(self, ids: np.ndarray) -> np.ndarray:
        """The block that starts at each word; -1: it holds a word that no item has."""
        if self.block == 1:
            return ids.astype(np.int64)
        a, b = ids[:-1].astype(np.int64), ids[1:]
        return np.where((a < 0) | (b < 0), -1, a * self.base + b)

    def mixed(self, block: np.ndarray, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Number of the last block, then a hash of the window's words."""
        h = np.zeros(len(start), np.uint64)
        for k in range(self.m):
            h = (h + ids[start + k].astype(np.uint64) + np.uint64(1)) * _ODD
            h ^= h >> np.uint64(29)
        return (block.astype(np.uint64) << _HASH_BITS) | (h >> (np.uint64(64) - _HASH_BITS))

    def find(self, words: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(place in words, places in ids) of the patterns that occur."""
        n, m, lead = len(words), self.m, self.m - self.block
        if n < m:
            return
        keys = self.keys(words)
        at = np.searchsorted(self.known, keys)
        at[at == len(self.known)] = 0
        shift = np.where(self.known[at] == keys, self.shift[at], self.most)
        if not (shift[lead:] == 0).any():
            return
        visited, steps, i = [], shift.tolist(), lead
        while i < len(steps):
            step = steps[i]
            if not step:
                visited.append(i)
            i += step or 1
        ends = np.array(visited, np.int64)
        if not len(ends):
            return
        start = ends - lead
        mixed = self.mixed(at[ends], words, start)
        low, high = np.searchsorted(self.bucket, mixed, "left"), np.searchsorted(self.bucket, mixed, "right")
        for k in np.flatnonzero(high > low).tolist():
            s = int(start[k])
            places = self.start[low[k] : high[k]]
            same = (ids[places[:, None] + np.arange(m)] == words[s : s + m]).all(1)
            if same.any():
                yield s, places[same]


class Searcher:
    """All lengths of a block of items (item_id, text)."""

    def __init__(self, items: list[tuple]):
        self.vocabulary: dict[bytes, int] = {}
        self.names, ids, ends = [], array("i"), [0]
        number = self.vocabulary.setdefault
        for item, text in items:
            words = words_of(text)
            if words:
                self.names.append(None if item is None else str(item))
                ids.extend([number(w, len(self.vocabulary)) for w in words])
                ends.append(len(ids))
        self.ids, self.ends = np.array(ids, np.int32), np.array(ends, np.int64)
        size = np.minimum(WINDOW, np.diff(self.ends))
        self.lengths = [Length(m, self.ids, self.ends[:-1][size == m], self.ends[1:][size == m], len(self.vocabulary) + 1) for m in np.unique(size).tolist()]

    def __call__(self, text: str | None) -> tuple[int, np.ndarray, set]:
        return self.many([text])[0]

    def many(self, texts: list[str | None]) -> list[tuple[int, np.ndarray, set]]:
        """(number of words, indexes of hit words, ids of found items) of each text; a word of no item stands between texts."""
        split = [words_of(t) for t in texts]
        n = [len(w) for w in split]
        start = np.cumsum([0, *(k + 1 for k in n)])
        get = self.vocabulary.get
        ids = np.fromiter(chain.from_iterable(chain(map(get, w, repeat(-1)), (-1,)) for w in split), np.int32, int(start[-1]))
        found: dict[int, set] = {}
        edge = np.zeros(len(ids) + 1, np.int32)
        for s in self.lengths:
            for at, places in s.find(ids, self.ids):
                edge[at] += 1
                edge[at + s.m] -= 1
                doc = int(np.searchsorted(start, at, "right")) - 1
                found.setdefault(doc, set()).update(self.names[k] for k in np.searchsorted(self.ends, places, "right") - 1)
        hit = np.cumsum(edge[:-1]) > 0 if found else edge[:-1]
        none = np.empty(0, np.int64)
        return [(k, np.flatnonzero(hit[a : a + k]) if d in found else none, found.get(d, set())) for d, (k, a) in enumerate(zip(n, start.tolist(), strict=False))]

    def bytes(self) -> int:
        """Of the arrays, without the vocabulary."""
        return self.ids.nbytes + self.ends.nbytes + sum(a.nbytes for s in self.lengths for a in (s.known, s.shift, s.start, s.bucket))


def searchers(items: list[tuple]) -> Searcher:
    return Searcher(items)


def search(text: str | None, tables: Searcher) -> tuple[int, np.ndarray, set]:
    return tables(text)


def _built(name: str, data: bytes) -> Searcher:
    """The process's tables of a block: a worker that runs more tasks of it builds them once, and holds one block's."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Searcher(pickle.loads(data))  # written by this module on the driver
    return _BUILT[name]


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple]]:
    block, held = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        size = len(r[1] or "")
        if block and held + size > most:
            yield block
            block, held = [], 0
        block.append((r[0], r[1]))
        held += size
    yield block


FOUND = "struct<n_words:bigint,hits:array<int>,items:array<string>>"
_FOUND = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def _finder(docs: DataFrame, block: list[tuple]):
    """A function of a text column: FOUND of a block of items; a null among ``items`` is an item without id."""
    data = pickle.dumps(block)
    name, shared = hashlib.sha256(data).hexdigest(), docs.sparkSession.sparkContext.broadcast(data)

    @F.arrow_udf(FOUND)
    def found(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = _built(name, shared.value)
        for texts in parts:
            out, some, held = [], [], 0
            for k in range(len(texts)):
                some.append(texts[k].as_py())
                held += len(some[-1] or "")
                if held >= CHUNK or k == len(texts) - 1:
                    out += tables.many(some)
                    some, held = [], 0
            yield pa.array([{"n_words": n, "hits": hit.tolist(), "items": sorted(items, key=lambda i: (i is not None, i))} for n, hit, items in out], _FOUND)
        trim()

    return found


def _judged(docs: DataFrame, benchmark: DataFrame, text: Column, tag: str, most: int) -> DataFrame:
    """docs with a column ``tag`` of FOUND, over all blocks."""
    blocks = _blocks(benchmark, most)
    block, earlier = next(blocks), None
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    for following in blocks:
        one = docs.select(digest.alias(f"{tag}_key"), _finder(docs, block)(text).alias("f")).filter(F.size("f.items") > 0)
        one = python_table(one.groupBy(f"{tag}_key").agg(F.first("f").alias("f")), "hits")
        earlier, block = one if earlier is None else earlier.unionByName(one), following
    now = docs.withColumn(tag, _finder(docs, block)(text))
    if earlier is None:
        return now
    known = earlier.groupBy(f"{tag}_key").agg(F.flatten(F.collect_list("f.hits")).alias(f"{tag}_hits"), F.flatten(F.collect_list("f.items")).alias(f"{tag}_items"))
    out = now.withColumn(f"{tag}_own", digest).hint("merge").join(known, F.col(f"{tag}_own") == known[f"{tag}_key"], "left")
    both = lambda field, more: F.array_sort(F.array_distinct(F.concat(F.col(f"{tag}.{field}"), F.coalesce(F.col(more), F.array()))))
    merged = F.struct(F.col(f"{tag}.n_words").alias("n_words"), both("hits", f"{tag}_hits").alias("hits"), both("items", f"{tag}_items").alias("items"))
    return out.withColumn(tag, merged).drop(f"{tag}_own", f"{tag}_key", f"{tag}_hits", f"{tag}_items")


def _contaminated(tag: str) -> Column:
    n = F.size(f"{tag}.hits").cast("long")
    return (n > 0) & (20 * n >= F.col(f"{tag}.n_words"))


def judge(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """The columns ``keep`` of docs (doc_id), and sw_words, sw_hit, sw_items (ids in order; a null for items without one), sw_contaminated of each document."""
    keep = keep or ["doc_id"]
    rows = _judged(docs.select(*keep, F.col("text").alias("sw_text")), benchmark, F.col("sw_text"), "sw_found", max_block_bytes)
    return rows.select(*keep, F.col("sw_found.n_words").alias("sw_words"), F.size("sw_found.hits").cast("long").alias("sw_hit"),
                       F.col("sw_found.items").alias("sw_items"), _contaminated("sw_found").alias("sw_contaminated"))


def digest(docs: DataFrame, benchmark: DataFrame, max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    j = python_table(judge(docs, benchmark, max_block_bytes=max_block_bytes), "judged")
    ids = F.sha2(F.concat_ws(",", F.array_sort("sw_items")).cast("binary"), 256)
    return j.select("doc_id", F.col("sw_words").alias("n_words"), F.col("sw_hit").alias("n_hit"), F.size("sw_items").cast("long").alias("n_items"),
                    ids.alias("items_sha256"), F.col("sw_contaminated").alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """The documents that are not contaminated, with all their columns; only texts go to Python."""
    tag = "sw"
    while any(c.lower().startswith(tag) for c in docs.columns):
        tag += "_"
    return _judged(docs, benchmark, F.col("text"), tag, max_block_bytes).filter(~_contaminated(tag)).select(*docs.columns)


__all__ = ["WINDOW", "Searcher", "clean", "digest", "judge", "search", "searchers"]
