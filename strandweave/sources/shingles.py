"""Runs of words by their hashes, found in whole batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: The position (others start at 1) of a run that so many documents of a batch hold that it is sent once.
MANY = 0

#: Bytes that words are made of, after lower-casing.
WORD = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits to 64 bits, one to one (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def factors(n: int, seed: int) -> np.ndarray:
    """Fixed random factors: sums of products with them are the same for two rows of n values with a chance of about 2^-59."""
    return mixed((np.arange(n, dtype=np.uint64) + np.uint64(seed << 32) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def places(texts: list[bytes], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, pos (from 1), h1 (64 bits), h2 (32 bits): every run of words of lower-cased texts, in their order."""
    data = np.frombuffer(b" ".join([*texts, b""]) + b" ", np.uint8)
    inside = WORD[data]
    borders = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        borders = np.concatenate(([0], borders))
    starts, sizes = borders[::2], borders[1::2] - borders[::2]
    n = len(starts) - run + 1
    if n < 1:
        return (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint32))
    first = np.cumsum(sizes) - sizes
    letters = data[inside].astype(np.uint64)
    letters *= factors(int(sizes.max()), 1)[np.arange(len(letters)) - np.repeat(first, sizes)]
    words = mixed(np.add.reduceat(letters, first))
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    text = np.searchsorted(begin, starts, side="right") - 1
    pos = np.arange(len(starts)) - np.searchsorted(text, text) + 1
    h1, h2 = (sum((words[k : k + n] * f for k, f in enumerate(factors(run, seed))), np.zeros(n, np.uint64)) for seed in (2, 3))
    whole = text[:n] == text[run - 1 :]
    return text[:n][whole], pos[:n][whole], mixed(h1[whole]), (mixed(h2[whole]) >> np.uint64(32)).astype(np.uint32)


def first_places(ids: pa.Array, texts: list[bytes], run: int, most: int, parts: int, part: int) -> pa.RecordBatch:
    """gene, pos, h1, h2: the first place of each run of one part in each document of a batch.

    A run that more than ``most`` of them hold is one row at MANY, as the others would say no more.
    """
    coded = pc.dictionary_encode(ids, null_encoding="encode")
    codes = coded.indices.to_numpy(zero_copy_only=False)
    by_id = np.argsort(codes, kind="stable")
    text, pos, h1, h2 = places([texts[k] for k in by_id], run)
    here = np.flatnonzero(h1 % np.uint64(parts) == part)
    here = here[np.argsort(h1[here], kind="stable")]
    gene, pos, h1, h2 = codes[by_id][text[here]], pos[here], h1[here], h2[here]
    if len(here):
        new_run = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        at = np.flatnonzero(new_run | np.concatenate(([True], gene[1:] != gene[:-1])))
        gene, pos, h1, h2, new_run = gene[at], np.minimum.reduceat(pos, at), h1[at], h2[at], new_run[at]
        which = np.cumsum(new_run) - 1
        many = (np.bincount(which) > most)[which]
        pos[many] = MANY
        rest = ~many | new_run
        gene, pos, h1, h2 = gene[rest], pos[rest], h1[rest], h2[rest]
    return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(gene)), pa.array(pos.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int32))], names=["gene", "pos", "h1", "h2"])


def sent(documents: DataFrame, run: int, most: int, parts: int, part: int) -> DataFrame:
    """gene, pos, h1, h2: ``first_places`` of the batches of a document table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield first_places(batch.column(0), batch.column(1).to_pylist(), run, most, parts, part)

    of = StructType([StructField("gene", documents.schema["doc_id"].dataType), StructField("pos", IntegerType()), StructField("h1", LongType()), StructField("h2", IntegerType())])
    return documents.select("doc_id", F.coalesce(F.lower("text"), F.lit("")).cast("binary").alias("text")).mapInArrow(work, of)
