"""A corpus pipeline of five stages: each gets the documents that its predecessor kept, from Parquet.

Defined results over all stages: a null text has no evidence, no shingles (such rows of different
ids are no copies), no benchmark words and no tokens.  Rows that repeat an id and its text, or a
null id and its text, are one document after the second stage; other texts of an id, or of null
ids, are documents of their own and are compared as all others.  In the fourth stage rows with
the same id are taken or left together, and the document on a leaf's border is kept whole, where
op1 tells how many of its tokens the budget takes.  The last stage gives every row a shard and a
slot; rows of one id share a shard, null ids are placed by their text.  An empty table passes
through all stages; columns beyond those of documents are carried along up to the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import decontam, minhash, mixing, sharding, toxicity
from strandweave.llm.common import materialize, python_table, table
from strandweave.llm.registry import PIPELINE_MIX, SHARDS


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; written here, where batches of texts for Python have a bound in bytes."""
    return python_table(toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), "not-toxic")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return minhash.deduplicate(docs, null_ids=True)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, by the rule of a twentieth of their words."""
    return python_table(decontam.clean(docs, table(spark, sf_dir, "benchmark")), "not-contaminated")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the token budgets take, each once."""
    _, cuts = mixing.plan(docs, PIPELINE_MIX)
    rows = docs.select(
        F.struct("*").alias("sw_row"), "doc_id", *[F.expr(e).alias(f"l_{n}") for n, e in PIPELINE_MIX.levels], mixing.n_tokens(F.col("text")).alias("tokens"))
    return mixing.selection(rows, cuts, PIPELINE_MIX).filter("copies > 0").select("sw_row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot."""
    return sharding.place(docs, sharding.Tree(SHARDS)).select("doc_id", "size", "text_crc32", "region", "rack", "shard", "slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]

#: SQL has no form of the toxicity and near-duplicate stages; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if not hasattr(docs, "sw_table"):  # some stages give a table of their own
            docs = materialize(docs, "stage-" + name.replace(" ", "-"))
    return docs
