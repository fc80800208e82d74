"""Shared helpers of the training-data operators.

Nothing here holds corpus-sized state on the driver; tables that must be cut
from their lineage are written to the folder that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, scratch, shared_dir, table

#: Rows that a key needs before ``skew_safe_join`` treats it as hot, and the share
#: of all rows; together they prove that at most 1 / HOT_SHARE keys are hot.
HOT_ROWS = 10_000
HOT_SHARE = 1 / 500

#: Bytes of a batch of rows on its way to Python: two tasks hold batches off the heap in both directions.
BATCH_BYTES = 1 << 20

#: Byte table: A-Z to a-z, every other byte that no word holds to a space.  Bytes
#: from 0x80 belong to words, so UTF-8 sequences stay whole.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text, as UTF-8."""
    return text.encode().translate(WORD_BYTES).split() if text else []


@contextmanager
def text_batches(spark: SparkSession, most: int = BATCH_BYTES) -> Iterator[None]:
    """What runs within sends rows to Python in batches of ``most`` bytes at most (one row at least); the caller's setting holds again after it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def python_table(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` of a frame that Python works on, in batches of bounded bytes."""
    with text_batches(df.sparkSession):
        return materialize(df, name)


def trim() -> None:
    """Gives memory that this Python worker has freed back to the system, as the worker lives on between tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def trimmed(work):
    """A function of batches that gives back what it freed when it ends."""

    def run(batches):
        yield from work(batches)
        trim()

    return run


def held_out(doc_id="doc_id"):
    """True where crc32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def skew_safe_join(facts: DataFrame, dims: DataFrame, key: str, rows: str) -> DataFrame:
    """Inner join of ``facts`` with ``dims`` (unique, non-null ``key``; column ``rows``: rows of the key in ``facts``).

    Keys that hold more than max(HOT_ROWS, HOT_SHARE of all rows) go through a
    broadcast of those keys alone; as their shares add up to at most 1, there are
    at most 1 / HOT_SHARE of them at any input size.  The rest is an ordinary
    shuffle join, in which no key is larger than that.
    """
    total = dims.agg(F.sum(rows)).first()[0] or 0
    least = max(HOT_ROWS, int(total * HOT_SHARE))
    hot = dims.filter(F.col(rows) > least)
    keys = [r[0] for r in hot.select(key).collect()]
    if not keys:
        return facts.hint("merge").join(dims, key)
    return (
        facts.filter(F.col(key).isin(keys)).join(F.broadcast(hot), key)
        .unionByName(facts.filter(~F.col(key).isin(keys)).hint("merge").join(dims.filter(F.col(rows) <= least), key))
    )


__all__ = ["WORD_BYTES", "held_out", "materialize", "python_table", "scratch", "shared_dir", "skew_safe_join", "table", "text_batches", "trim", "trimmed", "words_of"]
