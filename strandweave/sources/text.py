"""Text and binary sources as DataFrames: gene tables, hits, BLAST tables and reports, FASTA, cluster files, packed hits.

Every reader is one pass of Spark's text or binary source and Column expressions, so that
files are split and read where they are; only whole-file formats go through Arrow batches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.measures import kimura
from ..schemas import HITS, PACKED_HITS

#: Fixed value: the first byte of binary files of edges.
MAGIC = 197


class BadRows(ValueError):
    """More malformed rows than the source allows."""


def _fields(lines: DataFrame) -> DataFrame:
    return lines.withColumn("f", F.split(F.trim("value"), r"\s+"))


def _number(name: Column, kind: str) -> Column:
    return name.try_cast(kind)


def sections(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines before and after ``//`` of files that hold genes, then hits.

    The mark's place decides, so line order matters: lines are numbered file by file in
    whole-file reads, which such hand-made inputs allow.
    """
    whole = spark.read.text(path, wholetext=True)
    before = F.split("value", r"(?m)^//[^\n]*\n?", 2)
    lines = lambda k: whole.select(F.explode(F.split(before[k], "\n")).alias("value")).filter("value is not null and trim(value) <> ''")
    return lines(0), lines(1)


def genes(lines: DataFrame, most_bad: int = 10) -> DataFrame:
    """species, gene, length, pos, dir, trunc from lines ``species name length [pos] [dir] [trunc]``; # lines and // go."""
    rows = _fields(lines.filter(~F.col("value").rlike(r"^\s*(#|//|$)")))
    ok = (F.size("f") >= 3) & F.get("f", F.lit(2)).try_cast("int").isNotNull()
    if rows.filter(~ok).limit(most_bad + 1).count() > most_bad:
        raise BadRows(f"more than {most_bad} malformed gene rows")
    at = lambda k: F.get("f", F.lit(k))
    return rows.filter(ok).select(at(0).alias("species"), at(1).alias("gene"), at(2).cast("int").alias("length"), at(3).try_cast("int").alias("pos"),
                                  at(4).try_cast("int").alias("dir"), F.coalesce(at(5).try_cast("int"), F.lit(0)).alias("trunc"))


def hits(lines: DataFrame, by_score: bool = True, most_bad: int = 100) -> DataFrame:
    """Hits of 7, 8 or 9 columns: id1 id2 from1 to1 from2 to2 dist [score] [dir].  With 7 columns the measure counts as the score too."""
    rows = _fields(lines.filter(~F.col("value").rlike(r"^\s*(#|$)")))
    at = lambda k: F.get("f", F.lit(k))
    ok = F.size("f") >= 7
    for k in range(2, 7):
        ok = ok & at(k).try_cast("double").isNotNull()
    if rows.filter(~ok).limit(most_bad + 1).count() > most_bad:
        raise BadRows(f"more than {most_bad} malformed hit rows")
    score = F.coalesce(at(7).try_cast("float"), at(6).try_cast("float") if by_score else F.lit(None).cast("float"))
    return rows.filter(ok).select(at(0).alias("id1"), at(1).alias("id2"), *[at(k).cast("int").alias(n) for k, n in ((2, "from1"), (3, "to1"), (4, "from2"), (5, "to2"))],
                                  at(6).cast("float").alias("dist"), score.alias("score"), F.coalesce(at(8).try_cast("int"), F.lit(1)).alias("dir"))


def _counted(rows: DataFrame, ok: Column, most_bad: int, what: str) -> DataFrame:
    """The well-formed rows; BadRows if more than ``most_bad`` are not."""
    ok = F.coalesce(ok, F.lit(False))
    if rows.filter(~ok).limit(most_bad + 1).count() > most_bad:
        raise BadRows(f"more than {most_bad} malformed {what} rows")
    return rows.filter(ok)


def packed_text(spark: SparkSession, path: str, most_bad: int = 100) -> DataFrame:
    """Ten-column hits: id1 id2 from1 to1 from2 to2 ident eval score pam."""
    rows = _fields(spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#|$)")))
    names = ("id1", "id2", "from1", "to1", "from2", "to2", "ident", "eval", "score", "pam")
    kind = ("string", "string", *["int"] * 4, *["float"] * 4)
    ok = F.size("f") == 10
    for k, t in enumerate(kind):
        ok = ok & F.get("f", F.lit(k)).try_cast(t).isNotNull()
    return _counted(rows, ok, most_bad, "packed hit").select(*[F.get("f", F.lit(k)).try_cast(t).alias(n) for k, (n, t) in enumerate(zip(names, kind, strict=True))])


def blast_table(spark: SparkSession, path: str, most_bad: int = 100) -> DataFrame:
    """Twelve-column BLAST output: the distance from the identity, the bit score as the score; # lines go."""
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#|$)")).select(F.split("value", "\t").alias("f"))
    ok = F.size("f") >= 12
    for k in (2, 6, 7, 8, 9, 10, 11):
        ok = ok & F.trim(F.get("f", F.lit(k))).try_cast("double").isNotNull()
    f = _counted(lines, ok, most_bad, "BLAST")
    c = lambda k, t: F.trim(F.col("f")[k]).try_cast(t)
    return f.select(F.col("f")[0].alias("id1"), F.col("f")[1].alias("id2"), c(6, "int").alias("from1"), c(7, "int").alias("to1"), c(8, "int").alias("from2"), c(9, "int").alias("to2"),
                    kimura(c(2, "double") / 100).cast("float").alias("dist"), c(11, "float").alias("score"), c(10, "double").alias("evalue"))


def best_rows(blast: DataFrame) -> DataFrame:
    """One row a pair, the one of the least E-value, in units of a third of a bit: smaller id first, score times three, rounded distance."""
    turn = F.col("id1") > F.col("id2")
    pairs = [("id1", "id2"), ("from1", "from2"), ("to1", "to2")]
    put = {a: F.when(turn, F.col(b)).otherwise(F.col(a)) for a, b in pairs} | {b: F.when(turn, F.col(a)).otherwise(F.col(b)) for a, b in pairs}
    rows = blast.select(*[put[c].alias(c) for c in ("id1", "id2", "from1", "to1", "from2", "to2")], F.round("dist").alias("dist"), F.round(F.col("score") * 3).alias("score"), "evalue")
    least = rows.groupBy("id1", "id2").agg(F.min(F.struct("evalue", (-F.col("score")).alias("neg"), "from1", "to1", "from2", "to2", "dist", "score")).alias("b"))
    return least.select("id1", "id2", *[f"b.{c}" for c in ("from1", "to1", "from2", "to2", "dist", "score", "evalue")])


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """species, gene, length, title of records ``>species:gene title``; the reader splits at > where it begins a line."""
    r = spark.read.text(path, lineSep="\n>").filter("trim(value) <> ''").withColumn("value", F.regexp_replace("value", r"^\s*>", ""))
    head = F.split("value", "\n", 2)
    name = F.split(F.trim(head[0]), r"\s+", 2)
    return r.select(F.split(name[0], ":", 2)[0].alias("species"), F.get(F.split(name[0], ":", 2), F.lit(1)).alias("gene"),
                    F.length(F.regexp_replace(F.coalesce(F.get(head, F.lit(1)), F.lit("")), r"[^A-Za-z*]", "")).alias("length"), F.get(name, F.lit(1)).alias("title"))


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """cluster, subcluster, outgroup, species, gene, dom, from, to, file of block files (Cluster n / members / blank line).

    Blocks are those of their file: files may use the same numbers, so (file, cluster) names a cluster.
    """
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    lines = whole.select("file", F.posexplode(F.split("value", "\n")).alias("n", "value")).filter("trim(value) <> ''")
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    number = lambda word: F.nullif(F.regexp_extract("value", rf"^{word}\s*(\d+)", 1), F.lit(""))
    marked = lines.withColumn("c", number("Cluster")).withColumn("s", number("SubCluster")).withColumn("o", F.col("value").rlike("^OutGroup"))
    # A file can name a cluster twice; a block begins at each name.
    block = marked.withColumn("cluster", F.last("c", True).over(w)).withColumn("block", F.count("c").over(w))
    inside = Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    block = block.withColumn("subcluster", F.last("s", True).over(inside)).withColumn("outgroup", F.max("o").over(inside))
    f = _fields(block.filter("c is null and s is null and not o"))
    full = F.col("f")[0]
    bare = F.regexp_replace(full, r"\(\d+\)$", "")
    return f.filter(F.size("f") >= 3).select("cluster", "subcluster", "outgroup", F.split(bare, ":", 2)[0].alias("species"), F.split(bare, ":", 2)[1].alias("gene"),
                                             F.coalesce(F.regexp_extract(full, r"\((\d+)\)$", 1).try_cast("int"), F.lit(1)).alias("dom"), F.col("f")[1].cast("int").alias("from"), F.col("f")[2].cast("int").alias("to"), "file")


def representatives(spark: SparkSession, path: str) -> DataFrame:
    """representative, member of gene-cluster files: a line that starts with * names the representative, those after it its members."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    lines = whole.select("file", F.posexplode(F.split("value", "\n")).alias("n", "value")).filter("trim(value) <> ''")
    name = F.split(F.trim(F.regexp_replace("value", r"^\*", "")), r"\s+")[0]
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rep = F.last(F.when(F.col("value").startswith("*"), name), True).over(w)
    return lines.select(rep.alias("representative"), name.alias("member")).filter("representative is not null")


def _binary(spark: SparkSession, path: str, layout: str, schema: str, names: list[str], skip: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        record = struct.Struct(layout)
        for b in batches:
            for data in b["content"]:
                body = bytes(data)[skip:]
                rows = [tuple(v.split(b"\0")[0].decode() if isinstance(v, bytes) else v for v in r) for r in record.iter_unpack(body[: len(body) // record.size * record.size])]
                yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def edges_binary(spark: SparkSession, path: str) -> DataFrame:
    """Binary edge files: the magic byte, then records of two 80-byte names, four 16-bit positions, distance and score."""
    names = ["id1", "id2", "from1", "to1", "from2", "to2", "dist", "score"]
    return _binary(spark, path, "=80s80s4H2f", "id1 string, id2 string, from1 int, to1 int, from2 int, to2 int, dist float, score float", names, 1)


def packed_binary(spark: SparkSession, path: str) -> DataFrame:
    """Packed hits of 100 bytes: two 38-byte names, four 16-bit positions, identity, E-value, score, PAM."""
    names = ["id1", "id2", "from1", "to1", "from2", "to2", "ident", "eval", "score", "pam"]
    return _binary(spark, path, "=38s38s4H4f", PACKED_HITS, names, 0)


def is_binary(head: bytes) -> bool:
    return head[:1] == bytes([MAGIC])


def first_bytes(spark: SparkSession, path: str, n: int = 1) -> bytes:
    """The first bytes of a file, or of the first file of a folder, whatever store it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.getFileStatus(at).isDirectory():
        held = sorted(str(f.getPath()) for f in fs.listStatus(at) if f.isFile() and not f.getPath().getName().startswith(("_", ".")))
        if not held:
            return b""
        at = spark._jvm.org.apache.hadoop.fs.Path(held[0])
    stream, out = fs.open(at), []
    try:
        while len(out) < n and (b := stream.read()) >= 0:
            out.append(b)
    finally:
        stream.close()
    return bytes(out)


def edges(spark: SparkSession, path: str, format: str = "auto", by_score: bool = True, most_bad: int = 100) -> DataFrame:
    """Hits of an edge file, "text" or "binary"; "auto" looks at the first byte.  Of text with a // line, what follows it."""
    if format == "auto":
        format = "binary" if is_binary(first_bytes(spark, path)) else "text"
    if format == "binary":
        return edges_binary(spark, path).withColumn("dir", F.lit(1))
    lines = spark.read.text(path)
    if lines.filter(F.col("value").startswith("//")).take(1):
        lines = sections(spark, path)[1]
    return hits(lines, by_score, most_bad)


# Settings of a folder of hits and what they are by default.
FOLDER = {"uniqcheck": "1", "idxfile": None, "prefix": "", "suffix": "", "delim": "-"}


def folder_settings(spark: SparkSession, path: str) -> dict:
    """Settings of a folder from the lines ``key=value`` of its information file: uniqcheck (a number), idxfile, prefix, suffix, delim (a character)."""
    out = dict(FOLDER)
    for r in spark.read.text(path).filter(F.col("value").rlike("^(" + "|".join(FOLDER) + ")=")).toLocalIterator():
        key, _, value = r.value.partition("=")
        out[key] = value[:1] if key == "delim" else value
    digits = out["uniqcheck"].strip()
    return out | {"uniqcheck": int(digits) if digits.lstrip("-").isdigit() else 0}


def write_partitioned(hits_: DataFrame, path: str) -> None:
    """Hits in folders by species pair, smaller name first: the index of later scans is the folder tree."""
    a, b = F.split("id1", ":", 2)[0], F.split("id2", ":", 2)[0]
    hits_.withColumn("sp1", F.least(a, b)).withColumn("sp2", F.greatest(a, b)).repartition("sp1", "sp2").write.partitionBy("sp1", "sp2").parquet(path)


def read_pairs(spark: SparkSession, path: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """The hits of some species pairs in either order; other folders are not listed."""
    keep = F.lit(False)
    for x, y in pairs:
        keep = keep | ((F.col("sp1") == min(x, y)) & (F.col("sp2") == max(x, y)))
    return spark.read.parquet(path).filter(keep)


__all__ = ["HITS", "BadRows", "best_rows", "blast_table", "clusters", "edges", "edges_binary", "fasta", "first_bytes", "folder_settings", "genes", "hits", "is_binary", "packed_binary", "packed_text", "read_pairs", "representatives", "sections", "write_partitioned"]
