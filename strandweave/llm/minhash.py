"""Near-duplicate documents by ProbMinHash over weighted word shingles.

1. Documents with the same words (or, without words, the same text) become one node.
   A node is named by its least doc_id.
2. Signatures: a shingle is five consecutive words, its weight 1 + ln(count).  Each
   shingle starts a Poisson process whose rate is its weight, seeded by the shingle;
   every arrival falls on a random one of M registers, which keep the first arrival's
   shingle.  A process ends as soon as its next arrival is later than all registers'
   (early termination).  Two documents agree on a register with the probability of
   their probability Jaccard similarity
       J(u, v) = sum over d with u_d v_d > 0 of 1 / sum over e of max(u_e / u_d, v_e / v_d),
   which is the plain Jaccard similarity where all weights are equal.
3. BANDS bands of ROWS registers: a pair of similarity 0.8 shares one with probability
   1 - (1 - 0.8^ROWS)^BANDS > 0.99999.
4. Links within buckets, without all pairs of a bucket.  Short signatures (a byte a
   register) estimate J inside a bucket; pairs whose estimate is over four standard errors
   under 0.8 are never made.  The first turn makes the maximum spanning forest of each bucket's
   estimates; later turns, over all buckets of one largest class together, of each node outside it
   the TOP best pairs with other classes that were not tested, by longer signatures, TOP growing by 64 times, until no bucket
   leaves any out: nothing is capped.  A test computes J from the shingle sets, which one more
   pass over the texts writes for the documents that share a bucket; a link is J >= 0.8.  Buckets of more than BLOCK nodes are worked on in blocks: in later
   turns a block of the nodes of smaller classes meets a block of all nodes in a group of its own.
5. Classes are the connected components of links, by rounds of least labels.

Result: one row per document: doc_id, class_id (the least doc_id of the class), node_id,
n_links (tested links of its node to other nodes).

Defined results: null texts are alone in a class of their own; texts without words equal
only the same text; texts of one to four words have one shingle, all their words; rows
that repeat an id and its text are one document; each further text of an id, by hash, is a
document of its own, and names a class by a number from 2^62 if no first text is in it; an
empty table gives no rows; other columns play no part.  Rows with a null id: with ``null_ids``
each of their texts is a document, as a further text of an id is; without it they have no row
in the result of ``classes`` and pass ``deduplicate`` uncompared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, materialize, python_table, scratch, skew_safe_join, trimmed

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
M = BANDS * ROWS
#: Estimates that lie over four standard errors under the similarity are not tested: of
#: the M registers (0.032 each), and of the LONG ones of later turns (0.018 each).
FLOOR = 0.66
LONG, LONG_FLOOR = 512, 0.72
#: Pairs of a node in a bucket that the second turn tests; later turns 64 times the one before.
TOP = 64
#: Nodes of a bucket that are worked on at once.
BLOCK = 512
#: Bits of the filter that finds documents by id: so many an id, and at most 4 megabytes.
FILTER_PER_ID, MAX_FILTER_BITS = 16, 1 << 25
FILTER_SEED = 11
#: From here on are the keys of further texts of an id.
FURTHER = 1 << 62
#: Bytes of text that are worked on at once in a task.
CHUNK_BYTES = 1 << 18

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.frombuffer(hashlib.shake_128(b"shingle bytes").digest(256 * 8), "<u8")
_IS_WORD = np.frombuffer(WORD_BYTES, np.uint8) != 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, _kept: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """Powers of an odd number and of its inverse modulo 2^64."""
    if len(_kept.get("p", ())) < n:
        odd = 0xD6E8FEB86659FD93
        for name, base in (("p", odd), ("i", pow(odd, -1, 1 << 64))):
            steps = np.full(max(n, CHUNK_BYTES + 2), base, np.uint64)
            steps[0] = 1
            _kept[name] = np.multiply.accumulate(steps)
    return _kept["p"][:n], _kept["i"][:n]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, one text after the other; words of each text)."""
    raw = [t.encode() if t else b"" for t in texts]
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    data = (b" ".join(raw) + b" ").translate(WORD_BYTES)
    found, starts, low = [], [], 0
    while low < len(data):  # in parts that end between words
        high = min(low + CHUNK_BYTES, len(data))
        if high < len(data):
            high = data.rfind(b" ", low, high) + 1 or data.find(b" ", high) + 1
        part = np.frombuffer(data, np.uint8, high - low, low)
        flips = np.flatnonzero(np.diff(part != 0x20, prepend=False, append=False))
        start, end = flips[::2], flips[1::2]
        power, inverse = _powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_TABLE[part] * power[: len(part)], out=total[1:])
        found.append(mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * _GOLD))
        starts.append(start + low)
        low = high
    start = np.concatenate(starts) if starts else np.empty(0, np.int64)
    edges = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))
    return np.concatenate(found) if found else np.empty(0, np.uint64), np.diff(edges)


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle, count) sorted by index and shingle, and a hash of each text's word sequence."""
    h, n = word_hashes(texts)
    first = np.cumsum(n) - n
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(h)) - first[doc] if len(h) else np.empty(0, np.int64)
    width = np.minimum(n, SHINGLE)[doc] if len(h) else at
    full = at + width <= n[doc] if len(h) else np.empty(0, bool)
    total = np.zeros(len(h), np.uint64)
    for k in range(SHINGLE):
        moved = np.zeros(len(h), np.uint64)
        if k < len(h):
            moved[: len(h) - k] = h[k:]
        total = np.where(k < width, mix(total * _GOLD + moved + np.uint64(k + 1)), total)
    s, d = total[full], doc[full]
    order = np.argsort((d.astype(np.uint64) << np.uint64(48)) | (s >> np.uint64(16)), kind="stable")
    s, d = s[order], d[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    index = np.flatnonzero(new)
    return d[index], s[index], np.diff(np.append(index, len(s))), n


def weights(count: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(count)


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int, m: int = M) -> np.ndarray:
    """The m registers (shingles) of each document; 0 for documents without shingles."""
    best = np.full(n_docs * m, np.inf)
    who = np.zeros(n_docs * m, np.uint64)
    clock, live = np.zeros(len(shingle)), np.arange(len(shingle))
    slowest = np.full(n_docs, np.inf)
    seed, past, step = mix(shingle + _GOLD), 0, 1
    while len(live):
        # The next ``step`` arrivals of each live process, from a counter.
        state = mix(seed[live, None] + np.arange(past + 1, past + step + 1, dtype=np.uint64) * _GOLD)
        u = ((state >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
        arrive = clock[:, None] + np.cumsum(-np.log(u), 1) / weight[live, None]
        row, col = np.nonzero(arrive < slowest[doc[live], None])
        time, element = arrive[row, col], live[row]
        register = doc[element] * m + (mix(state[row, col] ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(best, register, time)
        won = time == best[register]
        register, element = register[won], element[won]
        who[register] = np.uint64(0xFFFFFFFFFFFFFFFF)
        np.minimum.at(who, register, shingle[element])  # of equal times, the smaller shingle
        touched = np.unique(doc[element])
        slowest[touched] = best.reshape(n_docs, m)[touched].max(1)
        clock = arrive[:, -1]
        go = clock < slowest[doc[live]]
        live, clock, past = live[go], clock[go], past + step
        step = 1 if past < 3 else 16
    return who.reshape(n_docs, m)


def bytes_of(registers: np.ndarray) -> np.ndarray:
    """A short signature: a byte a register."""
    return (mix(registers) & np.uint64(255)).astype(np.uint8)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """BANDS keys of each signature."""
    out = np.zeros((len(registers), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64) * _GOLD
    for k in range(ROWS):
        out = mix(out + registers[:, k::ROWS])
    return out


def similarity(a: np.ndarray, u: np.ndarray, b: np.ndarray, v: np.ndarray) -> float:
    """Probability Jaccard of two sorted shingle sets with weights."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    if min(u.min(), v.min()) == max(u.max(), v.max()):
        return len(i) / (len(a) + len(b) - len(i))
    x, y = u[i], v[j]
    # sum over e of max(u_e / x, v_e / y) = (shingles of a alone) / x + (of b alone) / y + the shared ones'.
    alone = (u.sum() - x.sum()) / x + (v.sum() - y.sum()) / y
    ratio, turn = x / y, np.argsort(x / y)
    r, sx, sy = ratio[turn], np.cumsum(x[turn]), np.cumsum(y[turn])
    # u_e / x >= v_e / y exactly where the ratio of e is at least that of d.
    low = np.searchsorted(r, ratio, "left")
    below = np.where(low > 0, sy[low - 1], 0.0)
    above = sx[-1] - np.where(low > 0, sx[low - 1], 0.0)
    return float((1.0 / (alone + above / x + below / y)).sum())


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    """(ids, texts) in small parts, so that a batch's texts are never all Python strings."""
    ids, texts, held = [], [], 0
    for k in range(0, batch.num_rows, 64):
        few = batch.slice(k, 64)
        for i, t in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            held += len(t or "")
            if held >= CHUNK_BYTES or len(ids) >= 1 << 15:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _pack(doc: np.ndarray, values: np.ndarray, n: int) -> list[np.ndarray]:
    return np.split(values, np.searchsorted(doc, np.arange(1, n)))


NODES = "doc_id bigint, node_key binary, bands array<bigint>, sig binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for ids, texts in _chunks(b):
            doc, s, count, n = shingles(texts)
            sig = signatures(doc, s, weights(count), len(texts))
            keys = band_keys(sig).view(np.int64)
            exact = [
                hashlib.blake2b(b" ".join(t.encode().translate(WORD_BYTES).split()), digest_size=16).digest() if k
                else hashlib.blake2b(b"no words " + t.encode() if t is not None else b"null %d" % i, digest_size=16).digest()
                for i, t, k in zip(ids, texts, n.tolist(), strict=True)
            ]
            bands = [row if k else None for row, k in zip(keys, n.tolist(), strict=True)]
            short = bytes_of(sig)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(exact, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                pa.array([x.tobytes() if k else None for x, k in zip(short, n.tolist(), strict=True)], pa.binary()),
            ], names=["doc_id", "node_key", "bands", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for ids, texts in _chunks(b):
            doc, s, count, _ = shingles(texts)
            few = [None if (c == 1).all() else c.astype(np.int32) for c in _pack(doc, count, len(texts))]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([x.tobytes() for x in _pack(doc, s, len(texts))], pa.binary()),
                pa.array([None if c is None else c.tobytes() for c in few], pa.binary())], names=["id", "s", "c"])


def _loaded(s: bytes, c: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """A shingle set with its weights."""
    s = np.frombuffer(s, np.uint64)
    return s, weights(np.frombuffer(c, np.int32)) if c is not None else np.ones(len(s))


def _long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Long signatures from shingle sets."""
    for b in batches:
        k = 0
        while k < b.num_rows:
            first, held, size = k, [], 0
            while k < b.num_rows and size < CHUNK_BYTES // 8:
                held.append(_loaded(b.column(1)[k].as_py(), b.column(2)[k].as_py()))
                size += len(held[-1][0])
                k += 1
            doc = np.repeat(np.arange(len(held)), [len(s) for s, _ in held])
            sig = bytes_of(signatures(doc, np.concatenate([s for s, _ in held]), np.concatenate([w for _, w in held]), len(held), LONG))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(held)), pa.array([x.tobytes() for x in sig], pa.binary())], names=["id", "sig"])


def _test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, p, s, c, ps, pc = b.columns
        kept, last, pivot = [], None, None
        for i in range(b.num_rows):
            if p[i].as_py() != last:
                last, pivot = p[i].as_py(), _loaded(ps[i].as_py(), pc[i].as_py())
            mine = _loaded(s[i].as_py(), c[i].as_py())
            if SIMILARITY * max(len(mine[0]), len(pivot[0])) > min(len(mine[0]), len(pivot[0])) and not c[i].is_valid and not pc[i].is_valid:
                continue
            if similarity(*mine, *pivot) >= SIMILARITY - 1e-12:
                kept.append(i)
        yield pa.RecordBatch.from_arrays([a.take(pa.array(kept, pa.int64())), p.take(pa.array(kept, pa.int64()))], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the least id of each connected component of edges (a, b); only ids that have an edge.

    Least labels over neighbours, then the label's own label; hubs are summed before they are shuffled.
    """
    with scratch(edges.sparkSession):
        both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
        labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "cc")
        while True:
            seen = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("near"))
            step = labels.join(seen, labels.id == seen.n).select("id", F.col("label").alias("old"), F.least("label", "near").alias("to"))
            up = labels.select(F.col("id").alias("u"), F.col("label").alias("up"))
            step = step.join(up, step["to"] == up["u"], "left").select("id", "old", F.least("to", F.coalesce("up", "to")).alias("label"))
            new = materialize(step, "cc")
            labels = new.select("id", "label")
            if not new.filter(F.col("old") != F.col("label")).take(1):
                return materialize(labels, "cc", keep=True)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarities of all rows of two sets of short signatures, corrected for equal bytes by chance."""
    same = np.zeros((len(a), len(b)), np.float32)
    for k in range(0, len(a), 16):  # bounded memory
        same[k : k + 16] = (a[k : k + 16, None, :] == b[None, :, :]).mean(2, dtype=np.float32)
    return (same - 1 / 256) / (1 - 1 / 256)


def forest(ids: np.ndarray, est: np.ndarray) -> list[tuple[int, int]]:
    """Maximum spanning forest of estimates from FLOOR, by Prim; ties to the smaller id."""
    n = len(ids)
    best, near, todo, out = np.full(n, -1.0, np.float32), np.zeros(n, np.int64), np.ones(n, bool), []
    for _ in range(n):
        k = int(np.where(todo, best, -2.0).argmax())
        todo[k] = False
        if best[k] >= FLOOR:
            out.append((k, int(near[k])))
        closer = todo & (est[k] > best)
        best[closer], near[closer] = est[k][closer], k
    return out


def _groups(work):
    """A function for mapInArrow over rows that are sorted by (bucket, at): calls ``work`` with whole groups.

    work(columns, starts, ends) gets the columns of many groups and gives (a, b, more); a pair's smaller id is put first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: pa.Table, cut: np.ndarray) -> pa.RecordBatch:
            c = {n: np.array(t.column(n)) for n in t.column_names if n != "sig"}
            c["sig"] = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(t.num_rows, -1)
            a, b, more = work(c, cut[:-1], cut[1:])
            low, high = np.minimum(a, b), np.maximum(a, b)
            return pa.RecordBatch.from_arrays([pa.array([*low.tolist(), *([None] * more)], pa.int64()), pa.array([*high.tolist(), *([None] * more)], pa.int64())], names=["a", "b"])

        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
            bucket, at = np.array(t.column("bucket")), np.array(t.column("at"))
            new = np.flatnonzero((bucket[1:] != bucket[:-1]) | (at[1:] != at[:-1])) + 1
            if len(new):  # the last group may go on in the next batch
                yield done(t.slice(0, new[-1]), np.concatenate([[0], new]))
                t = t.slice(new[-1])
            rest = t
        if rest is not None and rest.num_rows:
            yield done(rest, np.array([0, rest.num_rows]))

    return run


def _twos(sig: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Estimates of the pairs of rows (first, first + 1)."""
    same = (sig[first] == sig[first + 1]).mean(1, dtype=np.float32) if len(first) else np.empty(0, np.float32)
    return (same - 1 / 256) / (1 - 1 / 256)


def _first_pairs(c: dict, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    ids, sig = c["id"], c["sig"]
    two = starts[ends - starts == 2]
    two = two[_twos(sig, two) >= FLOOR]
    a, b = [ids[two]], [ids[two + 1]]
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        if e - s > 2:
            order = s + np.argsort(ids[s:e])
            found = np.array(forest(ids[order], estimates(sig[order], sig[order])), np.int64).reshape(-1, 2)
            a.append(ids[order[found[:, 0]]])
            b.append(ids[order[found[:, 1]]])
    return np.concatenate(a), np.concatenate(b), False


def _more_pairs(top: int):
    def work(c: dict, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        ids, cls, home, out, sig = c["id"], c["cls"], c["home"], c["outside"], c["sig"]
        two = starts[ends - starts == 2]
        two = two[(_twos(sig, two) >= LONG_FLOOR) & (cls[two] != cls[two + 1])]
        a, b, more = [ids[two]], [ids[two + 1]], False
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if e - s <= 2:
                continue
            mine, theirs = s + np.flatnonzero(out[s:e]), s + np.flatnonzero(home[s:e])
            for k in range(0, len(mine), 256):
                rows = mine[k : k + 256]
                est = estimates(sig[rows], sig[theirs])
                est[cls[rows][:, None] == cls[theirs][None, :]] = -1.0
                for r, x in zip(rows, est, strict=True):
                    hits = np.flatnonzero(x >= LONG_FLOOR)
                    if len(hits) > top:
                        more = True
                        hits = hits[np.lexsort((ids[theirs[hits]], -x[hits]))[:top]]
                    a.append(np.full(len(hits), ids[r]))
                    b.append(ids[theirs[hits]])
        return np.concatenate(a), np.concatenate(b), more

    return work


PAIRS = "a bigint, b bigint"


def classes(docs: DataFrame, null_ids: bool = False) -> DataFrame:
    """doc_id, class_id, node_id, n_links of every document; of an id with several texts, a row for each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not null_ids:
        rows = rows.filter(F.col("doc_id").isNotNull())
    if not _odd(rows):
        return _classes(rows)
    keyed = _keyed(rows).groupBy("sw_key").agg(F.min("sw_row.doc_id").alias("own"), F.min("sw_row.text").alias("text"))
    keyed = materialize(keyed, "documents")
    done = _classes(keyed.select(F.col("sw_key").alias("doc_id"), "text"))
    own = keyed.select("sw_key", "own")
    return done.hint("merge").join(own, done.doc_id == own.sw_key).select(F.col("own").alias("doc_id"), "class_id", "node_id", "n_links")


def _keyed(rows: DataFrame) -> DataFrame:
    """sw_row (all columns) and sw_key: the id with its first text by hash, a number from FURTHER with others and without an id."""
    text = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())
    rows = rows.select(F.struct("*").alias("sw_row"), F.col("doc_id").cast("long").alias("sw_id"), text.alias("sw_text"))
    # The first text of an id that has several; ids with one text are their own keys.
    many = rows.filter("sw_id is not null").groupBy(F.col("sw_id").alias("sw_many")).agg(F.min("sw_text").alias("sw_first"), F.max("sw_text").alias("sw_last")).filter("sw_first <> sw_last")
    further = F.xxhash64(F.coalesce("sw_id", F.lit(0)), F.col("sw_id").isNull(), "sw_text").bitwiseAND(F.lit(FURTHER - 1)).bitwiseOR(F.lit(FURTHER))
    key = F.when(F.col("sw_id").isNull() | (F.col("sw_first") != F.col("sw_text")), further).otherwise(F.col("sw_id"))
    return rows.hint("merge").join(many, rows.sw_id == many.sw_many, "left").select("sw_row", key.alias("sw_key"))


def _classes(rows: DataFrame) -> DataFrame:
    """doc_id, class_id, node_id, n_links of rows with unique ids (doc_id, text); of all tables on the way only this one stays."""
    with scratch(rows.sparkSession):
        return materialize(_worked(rows), "classes", keep=True)


def _worked(rows: DataFrame) -> DataFrame:
    signed = python_table(rows.mapInArrow(trimmed(_sign), NODES), "signed")
    nodes = materialize(signed.groupBy("node_key").agg(F.min("doc_id").alias("node_id"), F.count(F.lit(1)).alias("n_docs")), "nodes")
    reps = signed.join(nodes.select("node_id"), signed.doc_id == nodes.node_id, "left_semi").filter(F.col("bands").isNotNull())
    bands = materialize(reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("bucket")), "bands")
    shared = materialize(bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "buckets")
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    open_ = skew_safe_join(bands, shared, "bucket", "k").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id", "bucket"), blocks).cast("int"))
    open_ = materialize(open_.drop("k"), "open")
    sigs = materialize(signed.join(open_.select("id").distinct(), signed.doc_id == F.col("id"), "left_semi").select(F.col("doc_id").alias("id"), "sig"), "sigs")
    found = _sorted(open_.hint("merge").join(sigs, "id").select("bucket", F.col("block").alias("at"), "id", "sig")).mapInArrow(trimmed(_groups(_first_pairs)), PAIRS)
    new, tested, links, label, long, now, more, top = python_table(found.distinct(), "pairs"), None, None, None, None, None, True, TOP
    sets = python_table(_named(rows, open_.select("id").distinct(), _sets, "id bigint, s binary, c binary"), "sets")
    while True:
        linked = _links(new, sets)
        tested = new if tested is None else tested.union(new)
        links = linked if links is None else links.union(linked)
        if now is None or linked.take(1):
            label = components(links)
            now = _open_rows(open_, label)
            if now is None:
                break
            ids = now.select("id").distinct()
            if long is None:
                long = python_table(sets.join(ids, "id", "left_semi").select("id", "s", "c").mapInArrow(trimmed(_long), "id bigint, sig binary"), "sigs")
        elif not more:
            break
        found = _sorted(now.hint("merge").join(long, "id").select("bucket", "at", "id", "cls", "outside", "home", "sig")).mapInArrow(trimmed(_groups(_more_pairs(top))), PAIRS)
        found = python_table(found.distinct(), "found")
        more = bool(found.filter("a is null").take(1))
        new = materialize(found.filter("a is not null").join(tested, ["a", "b"], "left_anti"), "pairs")
        if not more and not new.take(1):
            break
        top *= 64
    every = links.distinct()
    degree = every.select("a").union(every.select("b")).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n_links"))
    per_node = nodes.join(label, nodes.node_id == label.id, "left").drop("id").join(degree, nodes.node_id == degree.id, "left")
    per_node = per_node.select("node_key", "node_id", F.coalesce("label", "node_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_docs")
    done = skew_safe_join(signed.select("doc_id", "node_key"), materialize(per_node, "node-classes"), "node_key", "n_docs")
    return done.select("doc_id", "class_id", "node_id", "n_links")


def _open_rows(open_: DataFrame, label: DataFrame) -> DataFrame | None:
    """The nodes of buckets that hold several classes, in a grid of blocks; None if there are none.

    At each place (bucket, at) the rows marked ``outside`` are held against those marked ``home``: every node
    outside the largest class meets every node of its bucket at one place.
    """
    now = open_.join(label, "id", "left").withColumn("cls", F.coalesce("label", "id")).drop("label")
    size = now.groupBy("bucket", "cls").agg(F.count(F.lit(1)).alias("k"))
    mixed = size.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"), F.max(F.struct("k", "cls")).alias("m")).filter("n > 1")
    mixed = materialize(mixed.select("bucket", "k", F.col("m.cls").alias("main")), "mixed")
    if not mixed.take(1):
        return None
    # Buckets of one largest class are taken together: bands of a group would make the same pairs over and over.
    now = skew_safe_join(now, mixed, "bucket", "k").select("main", "id", "cls").distinct().withColumn("outside", F.col("cls") != F.col("main"))
    now = materialize(now, "mixed-nodes")
    of = lambda k: F.greatest(F.lit(1), F.ceil(k / BLOCK)).cast("int")
    sizes = now.groupBy("main").agg(F.count(F.lit(1)).alias("n"), of(F.count(F.lit(1))).alias("blocks"), of(F.count_if("outside")).alias("lines"))
    now = skew_safe_join(now, materialize(sizes, "sizes"), "main", "n")
    # A grid: an outside node is held against all nodes, a block of the one against a block of the other at a place.
    block, line = (F.pmod(F.xxhash64("id", "main", F.lit(k)), F.col(c)).cast("int") for k, c in enumerate(("blocks", "lines")))
    now = now.withColumn("block", block).withColumn("line", line)
    column = F.transform(F.sequence(F.lit(0), F.col("lines") - 1), lambda k: k * F.col("blocks") + F.col("block"))
    row = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.col("line") * F.col("blocks") + k)
    now = now.withColumn("at", F.explode(F.when(F.col("outside"), F.array_union(column, row)).otherwise(column)))
    now = now.withColumn("outside", F.col("outside") & (F.floor(F.col("at") / F.col("blocks")) == F.col("line"))).withColumn("home", F.col("at") % F.col("blocks") == F.col("block"))
    return materialize(now.select(F.col("main").alias("bucket"), "at", "id", "cls", "outside", "home"), "now")


def _sorted(rows: DataFrame) -> DataFrame:
    """Groups of (bucket, at) whole and in a row."""
    return rows.repartition("bucket", "at").sortWithinPartitions("bucket", "at")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar enough, by the shingle sets of the documents that they name.

    Sets are joined by merging at every size: the larger side is never worth a broadcast,
    and hot ids are split by the planner, as nothing above the joins needs a key whole.
    """
    mine = pairs.hint("merge").join(sets, pairs.a == sets.id).drop("id")
    theirs = sets.select(F.col("id").alias("b"), F.col("s").alias("ps"), F.col("c").alias("pc"))
    full = mine.hint("merge").join(theirs, "b").select("a", "b", "s", "c", "ps", "pc")
    return python_table(full.mapInArrow(trimmed(_test), PAIRS), "links")


def _named(rows: DataFrame, ids: DataFrame, work, schema: str) -> DataFrame:
    """``work`` over the documents with the ids, without a shuffle of texts.

    The ids go into a Bloom filter, two bits an id of FILTER_PER_ID and MAX_FILTER_BITS in all,
    which is what is broadcast at any size; documents that it lets through by chance give rows
    that no later join asks for.  A filter that is full costs work, not results.
    """
    spark = rows.sparkSession
    size = 1 << 16
    while size < min(FILTER_PER_ID * ids.count(), MAX_FILTER_BITS):
        size *= 2
    h = F.xxhash64("id", F.lit(FILTER_SEED))
    places = F.array(F.pmod(h, F.lit(size)), F.pmod(F.shiftright(h, 32), F.lit(size)))
    bits = ids.select(F.explode(places).alias("p")).groupBy(F.floor(F.col("p") / 32).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 32 as int))")).alias("v"))
    words, table = np.zeros(size // 32, np.uint32), bits.toArrow()
    words[np.array(table.column("w"), np.int64)] = np.array(table.column("v"), np.int64).astype(np.uint32)
    shared = spark.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def few() -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = [np.array(b.column(k), np.int64) for k in (2, 3)]
                inside = np.logical_and(*[(shared.value[x >> 5] >> (x & 31).astype(np.uint32)) & 1 for x in p])
                if inside.any():
                    yield b.filter(pa.array(inside, pa.bool_())).select([0, 1])

        yield from work(few())

    h = F.xxhash64("doc_id", F.lit(FILTER_SEED))
    return rows.select("doc_id", "text", F.pmod(h, F.lit(size)).alias("p1"), F.pmod(F.shiftright(h, 32), F.lit(size)).alias("p2")).mapInArrow(trimmed(run), schema)


def _odd(rows: DataFrame) -> bool:
    """Whether an id is null or repeats."""
    return bool(rows.groupBy("doc_id").count().filter("count > 1 or doc_id is null").take(1))


def deduplicate(docs: DataFrame, null_ids: bool = False) -> DataFrame:
    """docs with one document of each class: the one that names it; of rows that repeat an id and its text, one stays."""
    named = docs if null_ids else docs.filter(F.col("doc_id").isNotNull())
    if not _odd(named):
        gone = materialize(classes(docs).filter("doc_id <> class_id").select(F.col("doc_id").alias("sw_gone")), "gone")
        return docs.join(gone, docs.doc_id == gone.sw_gone, "left_anti")
    known = materialize(_keyed(named).groupBy("sw_key").agg(F.min_by("sw_row", "sw_key").alias("sw_row")), "documents")
    done = _classes(known.select(F.col("sw_key").alias("doc_id"), F.col("sw_row.text").alias("text")))
    gone = materialize(done.filter("doc_id <> class_id").select(F.col("doc_id").alias("sw_gone")), "gone")
    left = known.join(gone, known.sw_key == gone.sw_gone, "left_anti").select("sw_row.*")
    return left if null_ids else left.unionByName(docs.filter(F.col("doc_id").isNull()))
