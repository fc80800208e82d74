"""Token-id files: each document's ids compressed on their own against one shared zstandard dictionary.

Format.  A dataset is a folder of two Parquet tables, written by Spark's committer so
that a task's second attempt replaces the first:
  * ``dictionary``: one row (sha256, data), the zstandard dictionary, trained on the
    serialized ids (little-endian unsigned 32 bit) of a bounded sample of documents;
  * ``segments``: rows (part, seg, dict_sha256, doc_ids, offsets, counts, before,
    n_ids, payload), before: the ids of the part's earlier segments.  payload is the zstandard frames of the documents one after the other;
    frame k takes bytes offsets[k] to offsets[k + 1] and holds counts[k] ids, so one
    document is read with the index columns, a slice of payload and the dictionary.
Segments ascend by doc_id over (part, seg).  A segment ends at SEGMENT_BYTES or
SEGMENT_DOCS.  Parts are ranges of (doc_id, checksum of the text, a number of the row), one for
about PART_BYTES of text and MAX_PARTS at most, so that an id or a text that many rows share is dealt over parts.
Global starts come from a running sum over the parts, ``before``, and a running sum in the segment.

With a tokenizer of the known kind pieces of texts are encoded once and kept, see ``Encoder``;
with any other whole texts are encoded.

Defined results: a null text is an empty one and holds only the end id; null ids come
first; rows that repeat an id follow each other by checksum of their text; an empty
table writes no segments; other columns play no part.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import python_table, shared_dir, text_batches

END_ID = 1
SEGMENT_BYTES = 4 << 20
SEGMENT_DOCS = 2048
MAX_WORDS = 600_000
#: Bytes of text of a part, on average, as long as there are no more than MAX_PARTS; more text makes larger parts.
#: The parts' starts, a number each, are broadcast.
PART_BYTES = 16 << 20
MAX_PARTS = 100_000
#: Bound of the sample that the dictionary is trained on, and the dictionary's size.
SAMPLE_DOCS = 2_000
SAMPLE_BYTES = 32 << 10
DICTIONARY_BYTES = 64 << 10
LEVEL = 3

_BEFORE_MARK = re.compile(rb"(?<=[a-z])([.,])(?=[ \n])")
_LATIN = "\u0250"
# The steps before the model of the tokenizer that pieces are right for.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
_END = END_ID.to_bytes(4, "little")
_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
_ENCODERS: dict[str, Encoder] = {}

SEGMENT = "part int, seg int, dict_sha256 string, doc_ids array<bigint>, offsets array<int>, counts array<int>, before bigint, n_ids bigint, payload binary"
READ = "doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint, ids array<bigint>"


def in_pieces(path: str) -> bool:
    """Whether a tokenizer's ids of a text are those of its pieces: its steps are the known ones and nothing else touches ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    same = spec["normalizer"] == _NORMALIZER and spec["pre_tokenizer"] == _SPLIT and not any(spec.get(k) for k in ("post_processor", "truncation", "padding"))
    return same and not spec["model"].get("dropout") and all(t["content"].startswith("<|") for t in spec["added_tokens"])


class Encoder:
    """Serialized ids of whole texts, where the tokenizer is of the known kind by pieces that are kept between calls.

    Texts are cut at spaces, tabs and line feeds, and before a full stop or comma that
    stands between an ASCII letter and white space; the tokenizer cuts there too, so a
    text's ids are its pieces' ids.  ASCII letters are lowered first, as the tokenizer
    does, unless the text could hold a special token.  Pieces are kept in two generations
    of MAX_WORDS at most; the older one is dropped as the younger is full.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        self.pieced = in_pieces(path)
        self.tokenizer, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # Lower-case Latin letters in composed form pass normalizing and splitting as they are.
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def pieces(text: str | None) -> list[str]:
        if not text:
            return []
        if "<|" not in text:
            text = _BEFORE_MARK.sub(rb" \1", text.encode().lower()).decode()
        return text.replace("\n", " ").replace("\t", " ").split(" ")

    @staticmethod
    def serialized(ids: list[int]) -> bytes:
        return array("I", ids).tobytes() if _LITTLE else np.array(ids, "<u4").tobytes()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if not self.pieced:
            return [self.serialized(e.ids) + _END for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        split = [self.pieces(t) for t in texts]
        if len(self.young) > MAX_WORDS:
            self.young, self.old = {"": b""}, self.young
        young, old, new = self.young, self.old, []
        for w in set().union(*split).difference(young):
            kept = old.get(w)
            if kept is None:
                new.append(w)
            else:
                young[w] = kept
        plain = [w for w in new if w.isalpha() and (w.islower() if w.isascii() else max(w) < _LATIN and w == w.lower() and is_normalized("NFC", w))]
        for tokenizer, words in ((self.letters, plain), (self.tokenizer, list(set(new).difference(plain)))):
            for i in range(0, len(words), 2048):
                part = words[i : i + 2048]
                for w, e in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                    young[w] = self.serialized(e.ids)
        return [b"".join(map(young.__getitem__, ws)) + _END for ws in split]


def encoder(path: str) -> Encoder:
    """The process's encoder: a worker that runs more tasks keeps its pieces."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def train(sample: list[bytes]) -> bytes:
    """A dictionary for serialized ids; where samples are too few to train one, their bytes."""
    import zstandard

    if not sample:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[-DICTIONARY_BYTES:]


def _sample(slim: DataFrame) -> list[str]:
    """Texts with the least hashes of doc_id, whatever the files: SAMPLE_DOCS at most, of SAMPLE_BYTES at most each."""
    share = min(1.0, 2 * SAMPLE_DOCS / max(1, slim.count()))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    rows = slim.filter((h <= int(share * (1 << 30))) & (F.octet_length("text") <= SAMPLE_BYTES)).orderBy(h, F.crc32(F.col("text").cast("binary"))).select("text").limit(SAMPLE_DOCS)
    return [r[0] for r in rows.collect()]


def write(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Encodes all texts and writes the dataset to ``path`` in ascending doc_id order."""
    import zstandard

    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    data = train(encoder(tokenizer)(_sample(slim)))
    sha = hashlib.sha256(data).hexdigest()
    spark.createDataFrame([(sha, data)], "sha256 string, data binary").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, seg, before = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(shared.value), write_checksum=False)
        ids, offsets, counts, payload = [], [0], [], bytearray()

        def segment():
            row = ([part], [seg], [sha], [ids], [offsets], [counts], [before], [sum(counts)], [bytes(payload)])
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, fields, strict=True)], schema=pa.schema(fields))

        for b in batches:
            for k in range(0, b.num_rows, 64):
                few = b.slice(k, 64)
                for doc, a in zip(few.column(0).to_pylist(), encode(few.column(1).to_pylist()), strict=True):
                    payload += press.compress(a)
                    ids.append(doc)
                    offsets.append(len(payload))
                    counts.append(len(a) // 4)
                    if len(payload) >= SEGMENT_BYTES or len(ids) >= SEGMENT_DOCS:
                        yield segment()
                        seg, before = seg + 1, before + sum(counts)
                        ids, offsets, counts, payload = [], [0], [], bytearray()
        if ids:
            yield segment()

    fields = [pa.field("part", pa.int32()), pa.field("seg", pa.int32()), pa.field("dict_sha256", pa.string()), pa.field("doc_ids", pa.list_(pa.int64())),
              pa.field("offsets", pa.list_(pa.int32())), pa.field("counts", pa.list_(pa.int32())), pa.field("before", pa.int64()),
              pa.field("n_ids", pa.int64()), pa.field("payload", pa.binary())]
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(MAX_PARTS, max(-(-size // PART_BYTES), spark.sparkContext.defaultParallelism))
    order = [F.col("doc_id").asc_nulls_first(), F.crc32(F.col("text").cast("binary")).asc_nulls_first(), F.xxhash64("row")]
    dealt = slim.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    with text_batches(spark):
        dealt.select("doc_id", "text").mapInArrow(run, SEGMENT).write.parquet(f"{path}/segments")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids of every document, from the files."""
    import zstandard

    sha, data = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(bytes(data)).hexdigest() != sha:
        raise ValueError("the dictionary does not have its own hash")
    shared = spark.sparkContext.broadcast(bytes(data))
    segments = spark.read.schema(SEGMENT).parquet(f"{path}/segments")
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    past = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("part_start"))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        undo = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared.value))
        for b in batches:
            for k in range(b.num_rows):  # a segment at a time, of at most SEGMENT_BYTES and one document
                row = b.slice(k, 1).to_pylist()[0]
                if row["dict_sha256"] != sha:
                    raise ValueError(f"segment {row['part']}.{row['seg']} was written with another dictionary")
                raw = [undo.decompress(row["payload"][a:z]) for a, z in zip(row["offsets"], row["offsets"][1:], strict=False)]
                if [len(x) // 4 for x in raw] != row["counts"]:
                    raise ValueError(f"segment {row['part']}.{row['seg']}: counts differ from the frames")
                n = np.array(row["counts"], np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array(row["part_start"] + row["before"] + np.cumsum(n) - n, pa.int64()), pa.array(n, pa.int64()),
                    pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                    pa.array([np.frombuffer(x, "<u4").astype(np.int64) if with_ids else None for x in raw], pa.list_(pa.int64())),
                ], names=["doc_id", "at", "n_tokens", "ids_crc32", "ids"])

    out = segments.join(F.broadcast(parts), "part").mapInArrow(run, READ)
    return out.select("doc_id", F.col("at").alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, tokenizer, path)
    return python_table(read(docs.sparkSession, path), "token-index")
