"""Genes and alignments from a document table: documents are genes, shared 8-word runs are hits.

A document's source is its species, its words are its residues.  A run of eight words
that 2 to 50 documents hold is a match; the matches of two documents make one hit, from
the first match's first word to the last one's last, its score their number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import freed_shuffles, materialize, scratch, table, text_batches
from . import shingles

RUN = 8
FEWEST, MOST = 2, 50
#: Turns that hits of texts of more than ONE_TURN bytes are made in; bytes of a batch of texts.
TURNS, ONE_TURN, BATCH_BYTES = 4, 32 << 20, 2 << 20
#: Documents of a batch that a run may stand in, if they are more than those that make no hit, before it is sent as one row.
HOT_ROWS = 64

_kept: dict = {}


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def genes(documents: DataFrame) -> DataFrame:
    """species, gene, length."""
    return documents.select(F.col("source").alias("species"), F.col("doc_id").alias("gene"), F.size(words(F.col("text"))).alias("length"))


def places(documents: DataFrame) -> DataFrame:
    """gene, pos, h1, h2: every run of a document, by its hash.

    Words are hashed once each, runs by the hashes of their words to 64 + 32 bits, so that strings are
    neither shuffled nor hashed again for every run that they are in.
    """
    def every(w: Column) -> Column:
        of = lambda i: [F.get(w, i + k) for k in range(RUN)]
        at = F.sequence(F.lit(0), F.greatest(F.size(w), F.lit(RUN)) - RUN)
        found = F.transform(at, lambda i: F.struct((i + 1).alias("pos"), F.xxhash64(*of(i)).alias("h1"), F.hash(*of(i)).alias("h2")))
        return F.when(F.size(w) >= RUN, found).otherwise(F.array().cast("array<struct<pos:int,h1:bigint,h2:int>>"))

    # A lambda holds the words' hashes, so that no other expression computes them again.
    hashed = F.array(F.transform(words(F.coalesce("text", F.lit(""))), lambda x: F.xxhash64(x)))
    return documents.select(F.col("doc_id").alias("gene"), F.inline(F.transform(hashed, every)[0]))


def runs(documents: DataFrame) -> DataFrame:
    """gene, run (h1, h2), pos, last: each different run of a document, with its first and last position."""
    return places(documents).groupBy("gene", "h1", "h2").agg(F.min("pos").alias("pos"), F.max("pos").alias("last"))


def hits(documents: DataFrame, most: int | None = MOST) -> DataFrame:
    """id1, id2, from1, to1, from2, to2, score with id1 < id2.

    Runs that more than ``most`` documents hold give no match, as in the queries' SQL; None takes
    all runs, whose pairs grow with the square of a run's documents.
    """
    if most is None:
        # Joined as rows, so that no row holds all documents of a run.
        found = runs(documents).select("gene", "h1", "h2", "pos")
        a, b = (found.select("h1", "h2", F.struct("gene", "pos").alias(n)) for n in "ab")
        return _matched(a.hint("merge").join(b, ["h1", "h2"]).filter(F.col("a.gene") < F.col("b.gene")))
    # Turns over parts of the runs: the places, by far the largest table, are shuffled a part at a time, and a turn's files go before the next.
    turns = TURNS if (documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > ONE_TURN else 1
    with text_batches(documents.sparkSession, BATCH_BYTES), freed_shuffles(documents.sparkSession):
        parts = [materialize(_matched(_pairs(shingles.sent(documents, RUN, max(most, HOT_ROWS), turns, k), most)), "hits-part") for k in range(turns)]
    if turns == 1:
        return parts[0]
    return reduce(DataFrame.unionByName, parts).groupBy("id1", "id2").agg(
        *[f(c).alias(c) for c, f in (("from1", F.min), ("to1", F.max), ("from2", F.min), ("to2", F.max))], F.sum("score").cast("int").alias("score"))


def _pairs(found: DataFrame, most: int) -> DataFrame:
    """a, b (gene, pos): two documents that hold one of the runs, with a's id before b's."""
    # One shuffle, by run: a document's places of a run, the run's documents and their pairs are all made where it brings them.
    # Most runs have one place and go first, by a sort alone; only the rest is grouped, as batches can share an id.
    run = Window.partitionBy("h1", "h2")
    n = F.count(F.lit(1)).over(run)
    shared = found.repartition("h1", "h2").withColumns({"n": n, "least": F.min("pos").over(run)}).filter((F.col("n") >= FEWEST) & (F.col("least") != shingles.MANY))
    held = shared.groupBy("h1", "h2", "gene").agg(F.min("pos").alias("pos"))
    fit = held.withColumn("n", n).filter(F.col("n").between(FEWEST, most))
    lists = fit.filter(F.col("gene").isNotNull()).groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("gene", "pos"))).alias("at"))
    firsts = lists.select("at", F.posexplode("at").alias("k", "a"))
    return firsts.select("a", F.explode(F.slice("at", F.col("k") + 2, F.size("at"))).alias("b"))


def _matched(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.col("a.gene").alias("id1"), F.col("b.gene").alias("id2")).agg(
        F.min("a.pos").alias("from1"), (F.max("a.pos") + RUN - 1).alias("to1"), F.min("b.pos").alias("from2"), (F.max("b.pos") + RUN - 1).alias("to2"),
        F.count(F.lit(1)).cast("int").alias("score"),
    )


def kept(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(genes, hits) of a data folder, written once a session and reread."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _kept:
        docs = table(spark, sf_dir, "documents")
        _kept.clear()
        with scratch(spark), freed_shuffles(spark):
            _kept[key] = materialize(genes(docs), "genes", keep=True), materialize(hits(docs), "hits", keep=True)
    return _kept[key]
