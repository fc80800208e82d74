"""The library's queries by name, each with the SQL that DuckDB answers alike (or none).

A query takes (spark, sf_dir).  Genes and hits are those of ``sources.bridge``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures, profiles, regions
from ..operators import besthit, edges, groups, intervals, merging, order, taxonomy, triangles
from ..operators.components import components
from ..params import Params
from ..sources import bridge
from ..storage import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Cutoffs of the two graphs: a rich one, and a strict one.
RICH, STRICT = 3, 57
SPECIES = [f"src{k}" for k in range(20)]

GENES_SQL = """genes AS (SELECT source AS species, doc_id AS gene, len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> ''))::INTEGER AS length FROM documents)"""
RUNS_SQL = """tok AS (SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents)),
sh AS (SELECT doc_id, s, min(pos) AS pos, max(pos) AS last FROM (SELECT doc_id, pos, string_agg(word, ' ') OVER w AS s, count(*) OVER w AS n FROM tok
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) WHERE n = 8 GROUP BY ALL)"""
HITS_SQL = RUNS_SQL + """,
ok AS (SELECT s FROM sh GROUP BY s HAVING count(*) BETWEEN 2 AND 50),
hits AS (SELECT a.doc_id AS id1, b.doc_id AS id2, min(a.pos)::INTEGER AS from1, (max(a.pos) + 7)::INTEGER AS to1, min(b.pos)::INTEGER AS from2, (max(b.pos) + 7)::INTEGER AS to2, count(*)::INTEGER AS score
  FROM sh a JOIN sh b USING (s) JOIN ok USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL)"""
LONG_SQL = GENES_SQL + ", " + HITS_SQL + """,
long AS (SELECT h.*, a.species AS species1, a.length AS length1, b.species AS species2, b.length AS length2 FROM hits h JOIN genes a ON h.id1 = a.gene JOIN genes b ON h.id2 = b.gene)"""


def labels_sql(least: int, name: str = "lab") -> str:
    """Components of the hits with a least score, by least label."""
    return f"""
{name}_e AS (SELECT id1 AS a, id2 AS b FROM hits WHERE score >= {least} UNION SELECT id2, id1 FROM hits WHERE score >= {least}),
{name}_r(id, label) AS (SELECT a, a FROM {name}_e UNION SELECT e.b, r.label FROM {name}_r r JOIN {name}_e e ON e.a = r.id WHERE r.label < e.b),
{name} AS (SELECT id, min(label) AS label FROM {name}_r GROUP BY id)"""


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _genes(spark: SparkSession, d: str) -> DataFrame:
    return bridge.kept(spark, d)[0]


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return bridge.kept(spark, d)[1]


def _long(spark: SparkSession, d: str) -> DataFrame:
    return edges.with_lengths(_hits(spark, d), _genes(spark, d))


_labels_kept: dict = {}


def _labels(spark: SparkSession, d: str, least: int) -> DataFrame:
    key = (spark.sparkContext.applicationId, d, least)
    if key not in _labels_kept:
        _labels_kept[key] = components(_hits(spark, d).filter(F.col("score") >= least))
    return _labels_kept[key]


# Scans


@query(f"WITH {GENES_SQL} SELECT * FROM genes")
def gene_scan(spark, d):
    return bridge.genes(table(spark, d, "documents"))


@query(f"WITH {GENES_SQL} SELECT species, count(*)::BIGINT AS genes, sum(length)::BIGINT AS residues, min(length) AS shortest, max(length) AS longest FROM genes GROUP BY species")
def gene_length(spark, d):
    return bridge.genes(table(spark, d, "documents")).groupBy("species").agg(
        F.count(F.lit(1)).alias("genes"), F.sum(F.col("length").cast("long")).alias("residues"), F.min("length").alias("shortest"), F.max("length").alias("longest"))


@query(f"WITH {HITS_SQL} SELECT * FROM hits")
def edge_build(spark, d):
    return bridge.hits(table(spark, d, "documents"))


# Filters, corrections


@query(f"""WITH {LONG_SQL}, k AS (SELECT id1, id2, least(1.0, score / least(length1, length2)::DOUBLE) AS i FROM long)
SELECT id1, id2, round(CASE WHEN 1 - (1 - i) - 0.2 * (1 - i) * (1 - i) > 0 THEN -ln(1 - (1 - i) - 0.2 * (1 - i) * (1 - i)) * 100 END, 6) AS dist FROM k""")
def kimura_distance(spark, d):
    identity = F.least(F.lit(1.0), F.col("score") / F.least("length1", "length2"))
    return _long(spark, d).select("id1", "id2", F.round(measures.kimura(identity), 6).alias("dist"))


@query(f"WITH {HITS_SQL} SELECT * FROM hits WHERE score >= 3")
def edge_admission(spark, d):
    return edges.admit(_hits(spark, d), Params(cutoff=4.0, miss_score=3.0))


@query(f"""WITH {LONG_SQL}, c AS (SELECT id1, id2, CASE WHEN length1 < length2 THEN (to1 - from1 + 1) / length1::DOUBLE ELSE (to2 - from2 + 1) / length2::DOUBLE END AS coverage FROM long)
SELECT id1, id2, round(coverage, 9) AS coverage FROM c WHERE coverage >= 0.2""")
def coverage_filter(spark, d):
    return edges.covered(_long(spark, d), 0.2).select("id1", "id2", F.round("coverage", 9).alias("coverage"))


@query(f"""WITH {LONG_SQL}, m AS (SELECT id1, id2, 100.0::DOUBLE - score AS dist, least(to1 - from1 + 1, to2 - from2 + 1) AS a, least(length1, length2, 250) AS m FROM long)
SELECT id1, id2, round(CASE WHEN a < 250 AND a < m THEN (dist * a + 284.0 * (m - a)) / m ELSE dist END, 6) AS dist FROM m""")
def short_penalty(spark, d):
    aligned = F.least(regions.length(F.col("from1"), F.col("to1")), regions.length(F.col("from2"), F.col("to2")))
    out = measures.short_alignment_penalty(F.lit(100.0) - F.col("score"), aligned, F.least("length1", "length2"), 284.0)
    return _long(spark, d).select("id1", "id2", F.round(out, 6).alias("dist"))


@query(f"""WITH {LONG_SQL} SELECT id1, id2, score + CASE WHEN species1 = species2 THEN 0.025::DOUBLE WHEN (species1 = 'src0') <> (species2 = 'src0') THEN -0.025::DOUBLE ELSE 0 END AS score FROM long""")
def tie_correction(spark, d):
    same, across = F.col("species1") == F.col("species2"), (F.col("species1") == "src0") != (F.col("species2") == "src0")
    return _long(spark, d).select("id1", "id2", measures.tie_correction(F.col("score").cast("double"), same, across, 40).alias("score"))


@query(f"WITH {HITS_SQL} SELECT * FROM hits")
def pair_canonical(spark, d):
    turn = (F.col("id1") + F.col("id2")) % 2 == 1
    pairs = {"id1": "id2", "id2": "id1", "from1": "from2", "from2": "from1", "to1": "to2", "to2": "to1"}
    mixed = _hits(spark, d).select(*[F.when(turn, F.col(pairs.get(c, c))).otherwise(F.col(c)).alias(c) for c in ("id1", "id2", "from1", "to1", "from2", "to2", "score")])
    return edges.canonical(mixed)


@query(f"""WITH {RUNS_SQL}, r AS (SELECT doc_id, min(pos) AS f1, max(pos) + 7 AS t1, min(last) AS f2, max(last) + 7 AS t2, count(*) AS n FROM sh WHERE last > pos GROUP BY doc_id)
SELECT doc_id AS id, least(f1, f2)::INTEGER AS from1, (CASE WHEN f1 <= f2 THEN t1 ELSE t2 END)::INTEGER AS to1, greatest(f1, f2)::INTEGER AS from2, (CASE WHEN f1 <= f2 THEN t2 ELSE t1 END)::INTEGER AS to2, n::INTEGER AS score
FROM r WHERE NOT (f1 = f2 AND t1 = t2)""")
def self_hit_order(spark, d):
    twice = bridge.runs(table(spark, d, "documents")).filter(F.col("last") > F.col("pos"))
    # The later copy is given first, so that ordering has work to do.
    own = twice.groupBy("gene").agg(F.min("last").alias("from1"), (F.max("last") + 7).alias("to1"), F.min("pos").alias("from2"), (F.max("pos") + 7).alias("to2"), F.count(F.lit(1)).cast("int").alias("score"))
    return edges.canonical(own.select(F.col("gene").alias("id1"), F.col("gene").alias("id2"), "from1", "to1", "from2", "to2", "score")).select(F.col("id1").alias("id"), "from1", "to1", "from2", "to2", "score")


@query(f"""WITH {LONG_SQL} SELECT least(species1, species2) AS a, greatest(species1, species2) AS b, score, id1, id2, from1, to1 FROM long
QUALIFY row_number() OVER (PARTITION BY least(species1, species2), greatest(species1, species2) ORDER BY score DESC, id1, id2) = 1""")
def best_edge_dedup(spark, d):
    rows = _long(spark, d).select(F.least("species1", "species2").alias("a"), F.greatest("species1", "species2").alias("b"), "score", "id1", "id2", "from1", "to1")
    return edges.best_of_pair(rows, ["a", "b"], "id1", "id2")


@query(f"WITH {HITS_SQL} SELECT id1, id2, score FROM hits WHERE NOT (id1 IN (SELECT doc_id FROM documents WHERE lang = 'en') AND id2 IN (SELECT doc_id FROM documents WHERE lang = 'en'))")
def unknown_gene_anti(spark, d):
    known = table(spark, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("gene"))
    return edges.unknown(_hits(spark, d), known).select("id1", "id2", "score")


@query(f"WITH {HITS_SQL}, l AS (SELECT doc_id FROM documents WHERE source = 'src3') SELECT id1, id2, score FROM hits WHERE id1 IN (SELECT * FROM l) OR id2 IN (SELECT * FROM l)")
def gene_list_either(spark, d):
    return edges.either(_hits(spark, d), table(spark, d, "documents").filter("source = 'src3'"), "doc_id").select("id1", "id2", "score")


@query(f"WITH {HITS_SQL}, l AS (SELECT doc_id FROM documents WHERE lang <> 'en') SELECT id1, id2, score FROM hits WHERE id1 IN (SELECT * FROM l) AND id2 IN (SELECT * FROM l)")
def gene_list_both(spark, d):
    return edges.both(_hits(spark, d), table(spark, d, "documents").filter("lang <> 'en'"), "doc_id").select("id1", "id2", "score")


@query("""SELECT user_id, count(*)::BIGINT AS n, count(DISTINCT event_type)::BIGINT AS kinds FROM events WHERE event_type <> 'click' AND value >= 10 GROUP BY user_id""")
def hit_thresholds(spark, d):
    e = table(spark, d, "events").filter((F.col("event_type") != "click") & (F.col("value") >= 10))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("kinds"))


@query("""SELECT page_id, CASE WHEN instr(name, '_p:') > 0 THEN substr(name, 1, instr(name, '_p:') - 1) || substr(name, instr(name, '_p:') + 2) ELSE name END AS name
FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'sp_p:' || page_id ELSE 'sp:' || page_id END AS name FROM pages)""")
def plasmid_names(spark, d):
    name = F.concat(F.when(F.col("page_id") % 3 == 0, F.lit("sp_p:")).otherwise(F.lit("sp:")), F.col("page_id").cast("string"))
    return table(spark, d, "pages").select("page_id", measures.strip_plasmid(name).alias("name"))


@query("""SELECT c_custkey, split_part(c_name, '#', 1) AS species, split_part(c_name, '#', 2) AS gene, try_cast(regexp_extract('g(' || c_nationkey || ')', '\\((\\d+)\\)$', 1) AS INTEGER) AS dom FROM customer""")
def name_parts(spark, d):
    name = F.regexp_replace("c_name", "#", ":")
    return table(spark, d, "customer").select("c_custkey", measures.species_of(name).alias("species"), F.coalesce(measures.gene_of(name), F.lit("")).alias("gene"),
                                              measures.domain_of(F.format_string("g(%d)", "c_nationkey")).alias("dom"))


# Best hits

_BEST_SQL = LONG_SQL + """,
seen AS (SELECT id1 AS g, species2 AS s, score FROM long UNION ALL SELECT id2, species1, score FROM long),
best AS (SELECT g, s, max(score) AS best FROM seen GROUP BY g, s),
wb AS (SELECT l.*, a.best AS best1, b.best AS best2 FROM long l JOIN best a ON a.g = l.id1 AND a.s = l.species2 JOIN best b ON b.g = l.id2 AND b.s = l.species1)"""


@query(f"WITH {_BEST_SQL} SELECT id1, id2, score, best1, best2 FROM wb WHERE (score + 0.1) * 100 / (best1 + 0.1) >= 90 AND (score + 0.1) * 100 / (best2 + 0.1) >= 90")
def best_hit_both(spark, d):
    return besthit.near_best(_long(spark, d), 90, "both").select("id1", "id2", "score", "best1", "best2")


@query(f"WITH {_BEST_SQL} SELECT id1, id2, score, best1, best2 FROM wb WHERE (score + 0.1) * 100 / (best1 + 0.1) >= 90 OR (score + 0.1) * 100 / (best2 + 0.1) >= 90")
def best_hit_any(spark, d):
    return besthit.near_best(_long(spark, d), 90, "any").select("id1", "id2", "score", "best1", "best2")


@query(f"WITH {_BEST_SQL} SELECT id1, id2, species1, species2, score FROM wb WHERE score = best1 AND score = best2 AND species1 <> species2")
def reciprocal_best(spark, d):
    return besthit.reciprocal(_long(spark, d)).select("id1", "id2", "species1", "species2", "score")


# Regions

_SIDES_SQL = HITS_SQL + """,
sides AS (SELECT id1 AS gene, id2 AS other, from1 AS f, to1 AS t FROM hits UNION ALL SELECT id2, id1, from2, to2 FROM hits)"""


@query(f"""WITH {_SIDES_SQL} SELECT a.gene, a.other AS a, b.other AS b, (least(a.t, b.t) - greatest(a.f, b.f) + 1)::INTEGER AS shared
FROM sides a JOIN sides b ON a.gene = b.gene AND a.other < b.other AND least(a.t, b.t) - greatest(a.f, b.f) + 1 >= 10""")
def region_overlap_join(spark, d):
    s = edges.mirrored(_hits(spark, d))
    a = s.select(F.col("id").alias("gene"), F.col("other").alias("a"), F.col("from").alias("lf"), F.col("to").alias("lt"))
    b = s.select(F.col("id").alias("gene"), F.col("other").alias("b"), F.col("from").alias("rf"), F.col("to").alias("rt"))
    both = intervals.overlap_join(a, b, "gene", 10).filter("a < b")
    return both.select("gene", "a", "b", (F.least("lt", "rt") - F.greatest("lf", "rf") + 1).cast("int").alias("shared"))


_CUT_SQL = "least(greatest(floor(least(to1 - from1 + 1, to2 - from2 + 1) * 0.6::DOUBLE), 10), greatest(floor(greatest(to1 - from1 + 1, to2 - from2 + 1) * 0.3::DOUBLE), 50))::INTEGER"


def _ends():
    return [F.col(c) for c in ("from1", "to1", "from2", "to2")]


def _cut():
    f1, t1, f2, t2 = _ends()
    return regions.overlap_cutoff(regions.length(f1, t1), regions.length(f2, t2))


@query(f"WITH {HITS_SQL} SELECT id1, id2, {_CUT_SQL} AS least FROM hits")
def overlap_cutoff(spark, d):
    return _hits(spark, d).select("id1", "id2", _cut().alias("least"))


@query(f"""WITH {HITS_SQL} SELECT id1, id2, (CASE WHEN to1 < from2 + {_CUT_SQL} THEN -1 WHEN to2 < from1 + {_CUT_SQL} THEN 1 ELSE 0 END)::INTEGER AS status FROM hits""")
def overlap_status(spark, d):
    return _hits(spark, d).select("id1", "id2", regions.overlap_status(*_ends(), _cut()).cast("int").alias("status"))


@query(f"""WITH {HITS_SQL} SELECT id1, id2, CASE WHEN from2 - from1 > 5 THEN from1 END AS left_from, CASE WHEN from2 - from1 > 5 THEN least(to1, from2) END AS left_to,
CASE WHEN least(to1, to2) - greatest(from1, from2) > 5 THEN greatest(from1, from2) END AS mid_from, CASE WHEN least(to1, to2) - greatest(from1, from2) > 5 THEN least(to1, to2) END AS mid_to,
CASE WHEN to1 - to2 > 5 THEN greatest(from1, to2) END AS right_from, CASE WHEN to1 - to2 > 5 THEN to1 END AS right_to FROM hits""")
def region_split(spark, d):
    return _hits(spark, d).select("id1", "id2", *[c.alias(n) for n, c in regions.split(*_ends(), F.lit(5)).items()])


@query(f"""WITH {HITS_SQL} SELECT id1, id2, p, (CASE WHEN to1 - from1 < 1 THEN NULL WHEN p < from1 THEN p - from1 + from2 WHEN p > to1 THEN p - to1 + to2
ELSE ((p - from1) * (to2 - from2)) // nullif(to1 - from1, 0) + from2 END)::INTEGER AS q FROM (SELECT *, unnest([from1 - 4, (from1 + to1) // 2, to1, to1 + 9])::INTEGER AS p FROM hits)""")
def region_transform(spark, d):
    f1, t1 = F.col("from1"), F.col("to1")
    some = F.array(f1 - 4, F.floor((f1 + t1) / 2).cast("int"), t1, t1 + 9)
    return _hits(spark, d).withColumn("p", F.explode(some)).select("id1", "id2", "p", regions.transform(F.col("p"), *_ends()).alias("q"))


@query(f"""WITH {HITS_SQL} SELECT id1, id2, round(CASE WHEN to1 < from2 OR to2 < from1 THEN 0 ELSE (least(to1, to2) - greatest(from1, from2) + 1) / least(to1 - from1 + 1, to2 - from2 + 1)::DOUBLE END, 9) AS overlap,
round((abs((from1 - from2) - (to1 - to2)) - abs((to1 - from1) - (to2 - from2))) / least(to1 - from1 + 1, to2 - from2 + 1)::DOUBLE, 9) AS gap FROM hits""")
def overlap_ratio(spark, d):
    return _hits(spark, d).select("id1", "id2", F.round(regions.overlap_ratio(*_ends()), 9).alias("overlap"), F.round(regions.gap_ratio(*_ends()), 9).alias("gap"))


def relation_sql(f1: str, t1: str, f2: str, t2: str, tol: int) -> str:
    eq = lambda a, b: f"abs({a} - {b}) <= {tol}"
    lt = lambda a, b: f"{a} < {b} - {tol}"
    tests = [lt(t1, f2), eq(t1, f2), f"{lt(f1, f2)} AND {lt(t1, t2)}", f"{eq(f1, f2)} AND {lt(t1, t2)}", f"{lt(f1, f2)} AND {eq(t1, t2)}", f"{lt(f2, f1)} AND {lt(t1, t2)}",
             f"{eq(f1, f2)} AND {eq(t1, t2)}", f"{lt(f1, f2)} AND {lt(t2, t1)}", f"{lt(f2, f1)} AND {eq(t1, t2)}", f"{eq(f1, f2)} AND {lt(t2, t1)}", f"{lt(f2, f1)} AND {lt(t2, t1)}",
             f"{lt(f2, f1)} AND {eq(t2, f1)}", lt(t2, f1)]
    return "(CASE " + " ".join(f"WHEN {t} THEN {k}" for k, t in enumerate(tests, 1)) + " ELSE 14 END)::INTEGER"


@query(f"WITH {HITS_SQL} SELECT id1, id2, {relation_sql('from1', 'to1', 'from2', 'to2', 10)} AS relation FROM hits")
def interval_relation13(spark, d):
    return _hits(spark, d).select("id1", "id2", regions.relation(*_ends(), F.lit(10)).alias("relation"))


_MATRIX = "[" + ", ".join("'" + "".join("01"[k in same] for k in regions.EQUIVALENT) + "'" for same in regions.EQUIVALENT.values()) + "]"


@query(f"""WITH {_SIDES_SQL}, p AS (SELECT a.gene, a.other AS a, b.other AS b, {relation_sql('a.f', 'a.t', 'b.f', 'b.t', 10)} AS r1, {relation_sql('h.from1', 'h.to1', 'h.from2', 'h.to2', 10)} AS r2
  FROM sides a JOIN sides b ON a.gene = b.gene AND a.other < b.other JOIN hits h ON h.id1 = a.other AND h.id2 = b.other)
SELECT gene, a, b, r1, r2, substr({_MATRIX}[r1], r2, 1) = '1' AS same FROM p WHERE r1 < 14 AND r2 < 14""")
def alignment_consistency(spark, d):
    out = triangles.alignment_relations(_hits(spark, d), 10).filter(f"r1 < {regions.UNKNOWN} and r2 < {regions.UNKNOWN}")
    return out.withColumn("same", regions.equivalent(F.col("r1"), F.col("r2")))


# Order


@query(f"""WITH {GENES_SQL}, n AS (SELECT species, gene, lead(gene) OVER (PARTITION BY species ORDER BY gene) AS next FROM genes) SELECT * FROM n WHERE next IS NOT NULL""")
def neighbor_lag(spark, d):
    return order.neighbors(_genes(spark, d), F.col("gene"))


@query(f"""WITH {GENES_SQL}, n AS (SELECT species, gene, coalesce(lead(gene) OVER (PARTITION BY species ORDER BY gene), min(gene) OVER (PARTITION BY species)) AS next FROM genes) SELECT * FROM n WHERE next <> gene""")
def neighbor_circular(spark, d):
    return order.neighbors(_genes(spark, d), F.col("gene"), circular=True)


@query("""WITH s AS (SELECT user_id, event_type, ts, event_id, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS start FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(start) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT user_id, island::BIGINT AS island, event_type, min(ts) AS first, max(ts) AS last, count(*)::BIGINT AS n FROM i GROUP BY user_id, island, event_type""")
def run_islands(spark, d):
    return order.islands(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id").withColumn("island", F.col("island").cast("long"))


@query(f"""WITH RECURSIVE {GENES_SQL}, {HITS_SQL}, {labels_sql(RICH)}, n AS (SELECT gene, lead(gene) OVER (PARTITION BY species ORDER BY gene) AS next FROM genes)
SELECT a.label AS "left", b.label AS "right", count(*)::BIGINT AS cnt FROM n JOIN lab a ON n.gene = a.id JOIN lab b ON n.next = b.id WHERE a.label <> b.label GROUP BY ALL""")
def neighbor_support(spark, d):
    return order.support(order.neighbors(_genes(spark, d), F.col("gene")), _labels(spark, d, RICH))


# Merging

_TOP_SQL = HITS_SQL + """,
top AS (SELECT id1 AS n1, id2 AS n2 FROM hits ORDER BY score DESC, id1, id2 LIMIT 1),
m AS (SELECT id1 AS id, id2 AS other, score FROM hits UNION ALL SELECT id2, id1, score FROM hits),
a AS (SELECT other AS third, score AS score1 FROM m, top WHERE id = n1 AND other <> n2),
b AS (SELECT other AS third, score AS score2 FROM m, top WHERE id = n2 AND other <> n1),
j AS (SELECT coalesce(a.third, b.third) AS third, score1, score2 FROM a FULL JOIN b ON a.third = b.third)"""


def _top(spark, d):
    h = _hits(spark, d)
    r = h.orderBy(F.desc("score"), "id1", "id2").select("id1", "id2").first()
    return merging.third_nodes(h, *(r or (None, None)))


@query(f"WITH {_TOP_SQL} SELECT * FROM j")
def third_node_outer_join(spark, d):
    return _top(spark, d)


@query(f"WITH {_TOP_SQL} SELECT third, round((coalesce(score1, 57.0::DOUBLE) * 3 + coalesce(score2, 57.0::DOUBLE) * 2) / 5, 9) AS merged FROM j")
def weighted_mean_impute(spark, d):
    return merging.merged_scores(_top(spark, d), 3, 2, 57.0).select("third", F.round("merged", 9).alias("merged"))


# Profiles: a part's species are its suppliers' nations

_PROF_SQL = "prof AS (SELECT l_partkey AS part, bit_or(1::BIGINT << s_nationkey) AS p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_partkey)"
_PAIR_SQL = _PROF_SQL + ", pair AS (SELECT a.part, a.p AS p1, b.p AS p2, a.p | b.p AS p0 FROM prof a JOIN prof b ON b.part = a.part + 1)"
#: Nations of regions 0 and 1 as a mask: those whose key is given here by rule.
MASK = sum(1 << k for k in range(0, 25, 3))


def _profiles(spark, d):
    l, s = table(spark, d, "lineitem").select("l_partkey", "l_suppkey"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    # Distinct (part, nation) is not needed: the union of bits is partial before its shuffle.
    return l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_partkey").alias("part")).agg(profiles.union(profiles.bit(F.col("s_nationkey"))).alias("p"))


def _profile_pairs(spark, d):
    p = _profiles(spark, d)
    after = p.select((F.col("part") - 1).alias("part"), F.col("p").alias("p2"))
    return p.withColumnRenamed("p", "p1").join(after, "part").withColumn("p0", F.col("p1").bitwiseOR(F.col("p2")))


@query(f"WITH {_PROF_SQL} SELECT part, p, bit_count(p)::INTEGER AS n FROM prof")
def profile_or(spark, d):
    return _profiles(spark, d).select("part", "p", profiles.count(F.col("p")).alias("n"))


@query(f"WITH {_PAIR_SQL} SELECT part, p1 & p2 AS common, bit_count(p1 & p2)::INTEGER AS n_common, xor(p1, p2) AS differ, (p1 & ~p2) AS only_first FROM pair")
def profile_and_count(spark, d):
    a, b = F.col("p1"), F.col("p2")
    return _profile_pairs(spark, d).select("part", a.bitwiseAND(b).alias("common"), profiles.common(a, b).alias("n_common"), a.bitwiseXOR(b).alias("differ"), profiles.minus(a, b).alias("only_first"))


@query(f"WITH {_PROF_SQL} SELECT part, (CASE WHEN bit_count(p & {MASK}) = 0 THEN 0 WHEN bit_count(p & {MASK}) = bit_count(p) THEN 2 ELSE 1 END)::INTEGER AS status FROM prof")
def mask_status(spark, d):
    return _profiles(spark, d).select("part", profiles.mask_status(F.col("p"), MASK).alias("status"))


@query(f"WITH {_PAIR_SQL} SELECT part, (p0 & p1) = p1 AS whole, (p1 & p2) = p2 AS includes, p1 = p2 AS equal FROM pair")
def profile_inclusion(spark, d):
    a, b = F.col("p1"), F.col("p2")
    return _profile_pairs(spark, d).select("part", profiles.includes(F.col("p0"), a).alias("whole"), profiles.includes(a, b).alias("includes"), (a == b).alias("equal"))


_WEIGHTS = [0.0 if k % 5 == 4 else 1.0 for k in range(25)]
_ONCE = sum(1 << k for k in range(25) if k % 5 == 4)


@query(f"WITH {_PROF_SQL} SELECT part, (bit_count(p & {sum(1 << k for k, w in enumerate(_WEIGHTS) if w)}) + CASE WHEN p & {_ONCE} <> 0 THEN 1 ELSE 0 END)::DOUBLE AS n FROM prof")
def weighted_species(spark, d):
    return _profiles(spark, d).select("part", profiles.weighted_count(F.col("p"), _WEIGHTS, [_ONCE]).alias("n"))


@query(f"""WITH {_PAIR_SQL} SELECT part, (CASE WHEN bit_count(p1 & p2) * bit_count(p1)::INTEGER * bit_count(p2) = 1 THEN 0 WHEN bit_count(p1 & p2) > bit_count(p1) * 0.5 OR bit_count(p1 & p2) > bit_count(p2) * 0.5 THEN 1
WHEN bit_count(p1 & p2) > bit_count(p1) * 0.3 OR bit_count(p1 & p2) > bit_count(p2) * 0.3 THEN 2 ELSE 0 END)::INTEGER AS cut FROM pair""")
def duplication_check(spark, d):
    return _profile_pairs(spark, d).select("part", profiles.duplication(F.col("p0"), F.col("p1"), F.col("p2"), 0.5, weak=0.3).alias("cut"))


# Taxonomy: all nations, regions, nations

_TREE_SQL = """tree AS (SELECT 0 AS node_id, 0 AS depth, bit_or(1::BIGINT << n_nationkey) AS profile FROM nation
UNION ALL SELECT 1 + n_regionkey, 1, bit_or(1::BIGINT << n_nationkey) FROM nation GROUP BY n_regionkey UNION ALL SELECT 100 + n_nationkey, 2, 1::BIGINT << n_nationkey FROM nation)"""


def _tree(spark, d):
    n = table(spark, d, "nation").withColumn("bit", profiles.bit(F.col("n_nationkey")))
    root = n.agg(profiles.union(F.col("bit")).alias("profile")).select(F.lit(0).alias("node_id"), F.lit(0).alias("depth"), "profile")
    mid = n.groupBy("n_regionkey").agg(profiles.union(F.col("bit")).alias("profile")).select((F.col("n_regionkey") + 1).alias("node_id"), F.lit(1).alias("depth"), "profile")
    return root.union(mid).union(n.select((F.col("n_nationkey") + 100).alias("node_id"), F.lit(2).alias("depth"), F.col("bit").alias("profile")))


@query(f"""WITH {_TREE_SQL}, prof AS (SELECT c_custkey // 3 AS grp, bit_or(1::BIGINT << c_nationkey) AS p FROM customer GROUP BY 1)
SELECT grp::BIGINT AS grp, p, node_id::INTEGER AS taxon FROM prof JOIN tree ON p & profile = p QUALIFY row_number() OVER (PARTITION BY grp ORDER BY depth DESC, node_id DESC) = 1""")
def taxon_lca(spark, d):
    c = table(spark, d, "customer")
    p = c.groupBy(F.floor(F.col("c_custkey") / 3).cast("long").alias("grp")).agg(profiles.union(profiles.bit(F.col("c_nationkey"))).alias("p"))
    return taxonomy.least_taxon(p, _tree(spark, d), "p").withColumn("taxon", F.col("taxon").cast("int"))


@query("""WITH RECURSIVE t AS (SELECT 0 AS node, NULL::INTEGER AS parent UNION ALL SELECT 1 + r_regionkey, 0 FROM region UNION ALL SELECT 100 + n_nationkey, 1 + n_regionkey FROM nation),
up(node, ancestor, depth) AS (SELECT node, node, 0 FROM t UNION ALL SELECT u.node, t.parent, u.depth + 1 FROM up u JOIN t ON u.ancestor = t.node WHERE t.parent IS NOT NULL)
SELECT node::INTEGER AS node, ancestor::INTEGER AS ancestor, depth::INTEGER AS depth FROM up""")
def ancestor_closure(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    root = spark.range(1).select(F.lit(0).alias("node"), F.lit(None).cast("int").alias("parent"))
    mid = r.select((F.col("r_regionkey") + 1).cast("int").alias("node"), F.lit(0).alias("parent"))
    low = n.select((F.col("n_nationkey") + 100).cast("int").alias("node"), (F.col("n_regionkey") + 1).cast("int").alias("parent"))
    return taxonomy.closure(spark, root.union(mid).union(low))


# Groups

_GROUPS_SQL = f"{GENES_SQL}, {HITS_SQL}, {labels_sql(RICH)}, mem AS (SELECT label, gene, species, length FROM lab JOIN genes ON id = gene)"


def _members(spark, d, least=RICH):
    return groups.members(_labels(spark, d, least), _genes(spark, d))


@query(f"WITH RECURSIVE {HITS_SQL}, {labels_sql(RICH)} SELECT id, label FROM lab")
def single_linkage(spark, d):
    return components(_hits(spark, d).filter(F.col("score") >= RICH))


@query(f"WITH RECURSIVE {_GROUPS_SQL}, s AS (SELECT label, count(*)::BIGINT AS members, count(DISTINCT species)::BIGINT AS species FROM mem GROUP BY label) SELECT * FROM s WHERE species >= 3 AND members >= 4")
def size_filter(spark, d):
    return groups.large(_members(spark, d), 3, 4)


@query(f"""WITH RECURSIVE {_GROUPS_SQL}, s AS (SELECT label, count(*)::BIGINT AS members, count(DISTINCT species)::BIGINT AS species FROM mem GROUP BY label)
SELECT *, row_number() OVER (ORDER BY members DESC, label)::INTEGER AS cluster_id FROM s WHERE species >= 2 AND members >= 2""")
def cluster_rank(spark, d):
    return groups.ranked(groups.large(_members(spark, d), 2, 2))


@query("WITH RECURSIVE " + _GROUPS_SQL + " SELECT label, " + ", ".join(f"string_agg(gene::VARCHAR, ' ' ORDER BY gene) FILTER (species = '{s}') AS {s}" for s in SPECIES) + " FROM mem GROUP BY label")
def cluster_table_pivot(spark, d):
    wide = groups.species_table(_members(spark, d), SPECIES)
    return wide.select("label", *[F.nullif(F.col(s), F.lit("")).alias(s) for s in SPECIES])


@query(f"WITH RECURSIVE {_GROUPS_SQL} SELECT label::VARCHAR AS cluster, species || ':' || gene AS gene, 1 AS dom, 1 AS \"from\", length AS \"to\" FROM mem")
def flat_table(spark, d):
    return _members(spark, d).select(F.col("label").cast("string").alias("cluster"), F.concat_ws(":", "species", F.col("gene").cast("string")).alias("gene"), F.lit(1).alias("dom"), F.lit(1).alias("from"), F.col("length").alias("to"))


@query(f"WITH RECURSIVE {_GROUPS_SQL} SELECT label, string_agg(species || ':' || gene, ',' ORDER BY species, gene) AS members FROM mem GROUP BY label")
def member_list(spark, d):
    pairs = F.array_sort(F.collect_list(F.struct("species", "gene")))
    return _members(spark, d).groupBy("label").agg(F.array_join(F.transform(pairs, lambda x: F.concat_ws(":", x["species"], x["gene"].cast("string"))), ",").alias("members"))


@query(f"WITH RECURSIVE {_GROUPS_SQL} SELECT label, gene, substr(text, 1, 20) AS title FROM mem LEFT JOIN (SELECT doc_id, text FROM documents WHERE lang = 'en') t ON gene = doc_id")
def title_join(spark, d):
    titles = table(spark, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("gene"), F.substring("text", 1, 20).alias("title"))
    return _members(spark, d).select("label", "gene").join(titles, "gene", "left")


_COMPARE_SQL = f"""{HITS_SQL}, {labels_sql(STRICT, 'a')}, {labels_sql(RICH, 'b')},
n1 AS (SELECT label, count(*) AS n1 FROM a GROUP BY label), n2 AS (SELECT label AS other, count(*) AS n2 FROM b GROUP BY label),
met AS (SELECT a.label, b.label AS other, count(*) AS common FROM a JOIN b ON a.id = b.id GROUP BY ALL),
best AS (SELECT label, other, common, n1, n2, common / (n1 + n2 - common)::DOUBLE AS jaccard FROM met JOIN n1 USING (label) JOIN n2 USING (other)
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY common / (n1 + n2 - common)::DOUBLE DESC, other) = 1)"""


def _two(spark, d):
    return tuple(_labels(spark, d, n).select(F.col("id").alias("gene"), "label") for n in (STRICT, RICH))


@query(f"WITH RECURSIVE {_COMPARE_SQL} SELECT label, other AS best, common::BIGINT AS common, round(jaccard, 9) AS jaccard FROM best")
def cluster_jaccard(spark, d):
    return groups.best_match(*_two(spark, d)).select("label", "best", "common", F.round("jaccard", 9).alias("jaccard"))


@query(f"WITH RECURSIVE {_COMPARE_SQL} SELECT label, common::BIGINT AS tp, (n2 - common)::BIGINT AS fp, (n1 - common)::BIGINT AS fn FROM best")
def tp_fp_fn(spark, d):
    return groups.marks(*_two(spark, d))


@query(f"""WITH {_SIDES_SQL}, d AS (SELECT DISTINCT gene, f, t FROM sides) SELECT gene, f AS "from", t AS "to", row_number() OVER (PARTITION BY gene ORDER BY f, t)::INTEGER AS dom FROM d""")
def domain_numbering(spark, d):
    rows = edges.mirrored(_hits(spark, d)).select(F.col("id").alias("gene"), "from", "to").distinct()
    return edges.rank_within(rows, ["gene"], "from", "to").withColumnRenamed("rank", "dom")


@query(f"""WITH RECURSIVE {_GROUPS_SQL}, s AS (SELECT label, count(*) AS n FROM mem GROUP BY label) SELECT count(*)::BIGINT AS groups, sum(n)::BIGINT AS members, max(n)::BIGINT AS largest, count(*) FILTER (n > 2)::BIGINT AS over_two FROM s""")
def stats_summary(spark, d):
    s = _members(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return s.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("members"), F.max("n").alias("largest"), F.count_if(F.col("n") > 2).alias("over_two"))


@query(f"""WITH {HITS_SQL}, m AS (SELECT id1 AS g FROM hits UNION ALL SELECT id2 FROM hits) SELECT g AS gene, count(*)::BIGINT AS n FROM m GROUP BY g""")
def multiplicity(spark, d):
    return edges.mirrored(_hits(spark, d)).groupBy(F.col("id").alias("gene")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {HITS_SQL} SELECT min(score) AS least, max(score) AS most, count(*)::BIGINT AS n FROM hits")
def measure_bounds(spark, d):
    return _hits(spark, d).agg(F.min("score").alias("least"), F.max("score").alias("most"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LONG_SQL}, s AS (SELECT least(species1, species2) AS sp1, greatest(species1, species2) AS sp2, score FROM long) SELECT sp1, sp2, count(*)::BIGINT AS hits, max(score) AS best FROM s WHERE (sp1, sp2) IN (('src0', 'src1'), ('src2', 'src3')) GROUP BY ALL""")
def pair_partitions(spark, d):
    """A scan of two species pairs of a table that is partitioned by them."""
    rows = _long(spark, d).select(F.concat_ws(":", "species1", F.col("id1").cast("string")).alias("id1"), F.concat_ws(":", "species2", F.col("id2").cast("string")).alias("id2"), "score")
    from ..sources import text
    from ..storage import shared_dir
    import uuid

    path = f"{shared_dir(spark)}/pairs-{uuid.uuid4().hex}"
    text.write_partitioned(rows, path)
    return text.read_pairs(spark, path, [("src1", "src0"), ("src2", "src3")]).groupBy("sp1", "sp2").agg(F.count(F.lit(1)).alias("hits"), F.max("score").alias("best"))


__all__ = ["QUERIES", "SQL"]
