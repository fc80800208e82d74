"""Exact top-k inner products of integer vectors by MaxScore.

The components of a query are its terms.  Candidates come in shards; a shard's posting
list of a term is its column, and the term's score bound for a query is the span between
the least and the greatest product that the shard's column allows.  For each query and
shard, terms in ascending order of bound are non-essential as long as the least possible
score plus their bounds stays below the query's k-th best score so far: a row that has no
more than that cannot enter.  Essential columns are traversed for all rows; rows that could
still enter are probed in the other columns, widest bounds first, and dropped as soon as
they cannot compete.  Ties that could enter by a smaller id are kept, so results are exact.

Queries are dealt in blocks of about QUERY_BLOCK rows and candidates in shards of about
SHARD_ROWS, both by a hash of the row's number, so that repeated ids and vectors spread.
A block meets a shard in a group of its own on an executor; nothing goes to the driver and
nothing is broadcast.  Where there is more than one shard, the queries meet shard 0 first,
and the k-th best score there is what the other shards start from.  Each group gives at
most k rows a query; these are merged by rank within the query.

Arithmetic is exact: a group's sums are float64 where no sum of products can reach 2^53,
64-bit integers where none can reach 2^63, and Python integers beyond.

Defined results: vectors that are null or hold null or non-finite components take no
part; vectors of different length are as if filled up with zeros; null ids take no part;
rows that repeat an id are queries and candidates each, a query's own row alone not being its
candidate; ties go to the smaller id; scores beyond the range of a long are ranked exactly and
given as the nearest long; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_batches

K = 20
SCALE = 64
#: Rows that search_shard takes at once.
SHARD = 2048
#: Rows of a block of queries and of a shard of candidates, on average.
QUERY_BLOCK = 2048
SHARD_ROWS = 16_384
PROBE = 8

FOUND = "query_row bigint, query_id bigint, vec_id bigint, place int, score bigint"
LONG = (1 << 63) - 1


def whole(vectors: list, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) of all components, exactly: float64 of whole numbers, or Python integers where float64 does not hold them."""
    raw = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        raw[i, : len(v)] = v
    with np.errstate(over="ignore"):
        out = np.floor(raw * scale)
    if np.isfinite(out).all():
        return out
    big = np.empty(raw.shape, object)  # a component beyond the range of floats after scaling is whole before it
    big[:] = [[int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale)) for x in row] for row in raw]
    return big


def exact(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices in the narrowest type in which every sum of products and of spans is exact."""
    most = lambda m: max((abs(int(x)) for x in (m.min(), m.max())), default=0) if m.size else 0
    reach = 4 * max(1, q.shape[1]) * most(q) * most(c)
    if reach < 1 << 53:
        kind = np.float64
    elif reach < 1 << 63:
        kind = np.int64
    else:
        return tuple(np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (q, c))
    return q.astype(kind), c.astype(kind)


class Heap:
    """The k best rows so far: score descending, id ascending.  ``least``: what a row must reach to enter, or None."""

    def __init__(self, k: int, least=None):
        self.k, self.least = k, least
        self.score, self.id = None, np.empty(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        s = score if self.score is None else np.append(self.score, score)
        i = np.append(self.id, ids)
        if len(s) > 4 * self.k:
            floor = np.partition(s, len(s) - self.k)[len(s) - self.k]
            s, i = s[s >= floor], i[s >= floor]
        order = np.argsort(i, kind="stable")
        order = order[np.argsort(-s[order], kind="stable")][: self.k]
        self.score, self.id = s[order], i[order]
        if len(order) == self.k and (self.least is None or self.score[-1] > self.least):
            self.least = self.score[-1]


def search_shard(q: np.ndarray, heap: Heap, ids: np.ndarray, own: np.ndarray, shard: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
    """Offers the rows of a shard (column-major) to a query's heap; ``own`` marks rows that are no candidates."""
    a, b = q * low, q * high
    least, span = np.minimum(a, b), np.abs(b - a)
    order = np.argsort(span, kind="stable")
    upto = least.sum() + np.cumsum(span[order])
    bar = heap.least
    if bar is None:
        n_out = 0
    else:
        if len(upto) and upto[-1] < bar:
            return
        n_out = int(np.searchsorted(upto, bar, "left"))
    essential, probed = order[n_out:], order[:n_out][::-1]
    score = shard[:, essential] @ q[essential] if len(essential) else np.zeros(len(ids), shard.dtype)
    rows = np.flatnonzero(~own)
    score = score[rows]
    rest = np.maximum(a, b)[probed]
    left = rest.sum() if len(rest) else 0
    for k in range(0, len(probed), PROBE):
        stay = score + left >= bar
        if not stay.all():
            rows, score = rows[stay], score[stay]
        if not len(rows):
            return
        terms = probed[k : k + PROBE]
        score = score + shard[np.ix_(rows, terms)] @ q[terms]
        left = left - rest[k : k + PROBE].sum()
    if bar is not None:
        stay = score >= bar
        rows, score = rows[stay], score[stay]
    if len(rows):
        heap.add(score, ids[rows])


def search_group(queries: pa.Table, candidates: pa.Table, k: int, scale: int) -> pa.Table:
    """The k best candidates of each query; both have row, vec_id and v, queries also least (of an exact long, or null)."""
    q_rows, q_ids, rows, ids = (np.array(t.column(c), np.int64) for t in (queries, candidates) for c in ("row", "vec_id"))
    qv, cv = queries.column("v").to_pylist(), candidates.column("v").to_pylist()
    width = max((len(v) for v in (*qv, *cv)), default=0)
    qs, cs = exact(whole(qv, scale, width), whole(cv, scale, width))
    heaps = [Heap(k, least) for least in queries.column("least").to_pylist()]
    for at in range(0, len(ids), SHARD):
        some, part = slice(at, at + SHARD), np.asfortranarray(cs[at : at + SHARD])
        low, high = (part.min(0), part.max(0)) if width else (np.empty(0), np.empty(0))
        for q, row, heap in zip(qs, q_rows, heaps, strict=True):
            search_shard(q, heap, ids[some], rows[some] == row, part, low, high)
    n = [len(h.id) for h in heaps]
    scores = [max(-LONG - 1, min(LONG, int(s))) for h in heaps if h.score is not None for s in h.score]
    return pa.table([
        pa.array(np.repeat(q_rows, n), pa.int64()), pa.array(np.repeat(q_ids, n), pa.int64()), pa.array(np.concatenate([np.empty(0, np.int64), *(h.id for h in heaps)]), pa.int64()),
        pa.array(np.concatenate([np.empty(0, np.int32), *(np.arange(x, dtype=np.int32) for x in n)]), pa.int32()), pa.array(scores, pa.int64()),
    ], names=["query_row", "query_id", "vec_id", "place", "score"])


def _meet(queries: DataFrame, candidates: DataFrame, k: int, scale: int) -> DataFrame:
    """FOUND of every (block, shard): queries (row, vec_id, v, least, block, shards), candidates (row, vec_id, v, shard, blocks)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return search_group(left, right, k, scale)

    a = queries.select("row", "vec_id", "v", "least", "block", F.explode("shards").alias("shard")).groupBy("block", "shard")
    b = candidates.select("row", "vec_id", "v", F.explode("blocks").alias("block"), "shard").groupBy("block", "shard")
    return a.cogroup(b).applyInArrow(run, FOUND)


def _renewed(rows: DataFrame) -> DataFrame:
    """The same rows by columns of their own, as a table meets itself below."""
    return rows.select(*[F.col(c).alias(c) for c in ("row", "vec_id", "v")])


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over groups.  Scores at an end of the range of a long stand for larger ones and have no order between groups, see ``search``."""
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "place"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(rows: DataFrame, is_query, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score over rows (vec_id, v array<double>, all whole and finite); ``is_query``: which rows are queries."""
    numbered = materialize(rows.select("vec_id", "v", F.monotonically_increasing_id().alias("row")).withColumn("query", is_query), "vectors")
    n = numbered.agg(F.count(F.lit(1)), F.count_if("query"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))), F.max(F.size("v"))).first()
    if not n[1]:
        return numbered.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    # Sums that a long cannot hold have no order once they are cut to it: then a block meets all shards at once, in digits.
    if n[2] * scale + 1 >= 2.0**31 / max(1, n[3]) ** 0.5:
        return _wide(numbered, k, scale)
    blocks, shards = (max(1, -(-n[i] // size)) for i, size in ((1, QUERY_BLOCK), (0, SHARD_ROWS)))
    spread = lambda m: F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")
    every = lambda m, first=0: F.sequence(F.lit(first), F.lit(m - 1))
    candidates = numbered.select("row", "vec_id", "v", spread(shards).alias("shard"), every(blocks).alias("blocks"))
    queries = _renewed(numbered.filter("query")).select("row", "vec_id", "v", F.lit(None).cast("long").alias("least"), spread(blocks).alias("block"))
    with text_batches(rows.sparkSession):
        found = materialize(_meet(queries.withColumn("shards", F.array(F.lit(0))), candidates.filter("shard = 0"), k, scale), "found")
        if shards > 1:
            bar = found.filter(F.col("place") == k - 1).select(F.col("query_row").alias("row"), F.col("score").alias("bar"))
            primed = queries.drop("least").join(bar, "row", "left").withColumnRenamed("bar", "least").withColumn("shards", every(shards, 1))
            found = found.unionByName(materialize(_meet(primed, candidates.filter("shard > 0"), k, scale), "found"))
    return _best(found, k).select("query_id", "rank", "vec_id", "score")


def _wide(numbered: DataFrame, k: int, scale: int) -> DataFrame:
    """As ``search``, for scores beyond a long: groups give exact decimal text, ordered by sign, number of digits and digits."""
    n = numbered.agg(F.count(F.lit(1)), F.count_if("query")).first()
    blocks, shards = (max(1, -(-n[i] // size)) for i, size in ((1, QUERY_BLOCK), (0, SHARD_ROWS)))
    spread = lambda m: F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")
    every = lambda m: F.sequence(F.lit(0), F.lit(m - 1))
    a = _renewed(numbered.filter("query")).select("row", "vec_id", "v", F.lit(None).cast("long").alias("least"), spread(blocks).alias("block"), F.explode(every(shards)).alias("shard"))
    b = numbered.select("row", "vec_id", "v", F.explode(every(blocks)).alias("block"), spread(shards).alias("shard"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for i in range(left.num_rows):
            one = left.slice(i, 1)
            width = max((len(v) for t in (one, right) for v in t.column("v").to_pylist()), default=0)
            q, cs = exact(whole(one.column("v").to_pylist(), scale, width), whole(right.column("v").to_pylist(), scale, width))
            heap, ids = Heap(k), np.array(right.column("vec_id"), np.int64)
            own = np.array(right.column("row"), np.int64) == one.column("row")[0].as_py()
            part = np.asfortranarray(cs)
            search_shard(q[0], heap, ids, own, part, part.min(0), part.max(0))
            for c, s in zip(heap.id.tolist(), [] if heap.score is None else [int(x) for x in heap.score], strict=True):
                digits = str(abs(s))
                out.append((one.column("row")[0].as_py(), one.column("vec_id")[0].as_py(), c, 0 if s < 0 else 1, len(digits), digits, max(-LONG - 1, min(LONG, s))))
        cols = list(zip(*out, strict=True)) if out else [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["query_row", "query_id", "vec_id", "sign", "size", "digits", "score"])

    schema = "query_row bigint, query_id bigint, vec_id bigint, sign int, size int, digits string, score bigint"
    with text_batches(numbered.sparkSession):
        found = materialize(a.groupBy("block", "shard").cogroup(b.groupBy("block", "shard")).applyInArrow(run, schema), "found")
    # Of negative numbers the one with fewer and smaller digits is larger.
    up = F.col("sign") == 1
    order = [F.desc("sign"), F.desc(F.when(up, F.col("size")).otherwise(-F.col("size"))), F.desc(F.when(up, F.col("digits"))), F.asc(F.when(~up, F.col("digits"))), "vec_id"]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) of whole, finite vectors with an id."""
    inf = float("inf")
    e = F.col("embedding").cast("array<double>")
    fit = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (x < inf) & (x > -inf))
    return embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(fit).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("v"))


def divisible(embeddings: DataFrame, by: int = 20) -> DataFrame:
    return search(usable(embeddings), F.col("vec_id") % by == 0)
