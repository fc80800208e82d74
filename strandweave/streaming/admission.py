"""Edges that keep coming: admission, and the best edge of each pair so far, as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edges
from ..params import Params

#: Columns of hit files that are watched.
FILES = "id1 string, id2 string, from1 int, to1 int, from2 int, to2 int, score double"


def watch(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Parquet hit files as they appear in a folder."""
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def admitted(hits: DataFrame, genes: DataFrame, params: Params) -> DataFrame:
    """A stream's hits beyond the missing value, of known genes, the smaller id first; no state is kept."""
    return edges.canonical(edges.with_lengths(edges.admit(hits, params), genes))


def best_so_far(hits: DataFrame) -> DataFrame:
    """The best edge of each pair: state is one row a pair.  For update or complete output."""
    best = F.max(F.struct("score", "from1", "to1", "from2", "to2")).alias("b")
    return hits.groupBy("id1", "id2").agg(best).select("id1", "id2", "b.*")
