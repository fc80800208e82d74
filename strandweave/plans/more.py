"""Further queries of the catalogue: hit selection, families, outgroups, taxon mapping, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import measures, profiles
from ..operators import subgroups, taxonomy
from ..operators.select import Selection, select
from ..sources import sinks
from ..storage import table
from .catalogue import _GROUPS_SQL, _PAIR_SQL, _PROF_SQL, _TREE_SQL, HITS_SQL, LONG_SQL, MASK, RICH, SPECIES, STRICT, _labels, _long, _members, _profile_pairs, _profiles, _tree, labels_sql, query

_PACKED_SQL = LONG_SQL + """,
packed AS (SELECT id1, id2, species1, species2, from1, to1, from2, to2, score, round(100.0 * least(1.0, score / least(length1, length2)::DOUBLE), 6) AS ident, (100 + (id1 * 7 + id2 * 13) % 200)::DOUBLE AS pam, 1.0 / score::DOUBLE AS eval FROM long)"""


def _packed(spark, d):
    i = F.round(100.0 * F.least(F.lit(1.0), F.col("score") / F.least("length1", "length2")), 6)
    return _long(spark, d).select("id1", "id2", "species1", "species2", "from1", "to1", "from2", "to2", "score", i.alias("ident"), (100 + (F.col("id1") * 7 + F.col("id2") * 13) % 200).cast("double").alias("pam"), (F.lit(1.0) / F.col("score")).alias("eval"))


@query(f"""WITH {_PACKED_SQL}, f AS (SELECT * FROM packed WHERE pam <= 250 AND score >= 2 AND eval <= 0.4 AND ident >= 0.1 AND id1 <> id2),
seen AS (SELECT id1 AS g, species2 AS s, score FROM f UNION ALL SELECT id2, species1, score FROM f), best AS (SELECT g, s, max(score) AS best FROM seen GROUP BY g, s)
SELECT f.id1, f.id2, f.from1, f.to1, f.from2, f.to2, f.score, 100.0::DOUBLE - f.ident AS dist FROM f JOIN best a ON a.g = f.id1 AND a.s = f.species2 JOIN best b ON b.g = f.id2 AND b.s = f.species1
WHERE (f.score + 0.1) * 100 / (a.best + 0.1) >= 50 AND (f.score + 0.1) * 100 / (b.best + 0.1) >= 50""")
def select_pipeline(spark, d):
    s = Selection(most_pam=250, least_score=2, most_evalue=0.4, least_identity=0.1, identity_distance=True, near_best=50, ends="both")
    return select(_packed(spark, d), s).select("id1", "id2", "from1", "to1", "from2", "to2", "score", "dist")


@query(f"WITH {_PACKED_SQL} SELECT id1, id2, score, pam AS dist FROM packed WHERE (id1 IN (SELECT doc_id FROM documents WHERE source = 'src5') OR id2 IN (SELECT doc_id FROM documents WHERE source = 'src5')) AND score >= 2")
def select_listed(spark, d):
    names = table(spark, d, "documents").filter("source = 'src5'").select("doc_id")
    return select(_packed(spark, d), Selection(least_score=2), names).select("id1", "id2", "score", "dist")


@query(f"""WITH {_PACKED_SQL} SELECT id1, id2, round(length1::DOUBLE * length2 * eval / 100000.0, 9) AS evalue FROM packed JOIN (SELECT id1, id2, length1, length2 FROM long) USING (id1, id2)""")
def modified_evalue(spark, d):
    return _long(spark, d).select("id1", "id2", F.round(measures.modified_evalue(F.lit(1.0) / F.col("score"), F.col("length1"), F.col("length2")), 9).alias("evalue"))


@query(f"""WITH RECURSIVE {HITS_SQL}, {labels_sql(STRICT, 'a')}, {labels_sql(RICH, 'b')}, met AS (SELECT DISTINCT a.label AS x, b.label AS y FROM a JOIN b ON a.id = b.id),
e AS (SELECT m.x AS p, n.x AS q FROM met m JOIN met n USING (y)), r(id, f) AS (SELECT p, p FROM e UNION SELECT e.q, r.f FROM r JOIN e ON e.p = r.id WHERE r.f < e.q)
SELECT id AS label, min(f) AS family FROM r GROUP BY id""")
def homology_union(spark, d):
    """Strict groups joined into families by the rich groups that they meet in."""
    return subgroups.unions(_labels(spark, d, STRICT), _labels(spark, d, RICH))


_STAND = lambda p: f"(CASE WHEN bit_count({p} & {MASK}) > 0 THEN 2 ELSE 0 END + CASE WHEN bit_count({p} & ~{MASK}) > 0 THEN 1 ELSE 0 END)"
_CASES = " ".join(f"WHEN {_STAND('p1')} = {x} AND {_STAND('p2')} = {y} THEN '{n}'" for (x, y), n in subgroups.PATTERNS.items())


@query(f"WITH {_PAIR_SQL} SELECT part, CASE {_CASES} ELSE 'none' END AS pattern FROM pair")
def outgroup_pattern(spark, d):
    return _profile_pairs(spark, d).select("part", subgroups.pattern(F.col("p1"), F.col("p2"), MASK).alias("pattern"))


@query(f"WITH {_PROF_SQL} SELECT part, bit_count(p)::INTEGER AS n FROM prof WHERE bit_count(p & 7) > 0")
def species_mask(spark, d):
    return subgroups.masked(_profiles(spark, d), "p", 7).select("part", profiles.count(F.col("p")).alias("n"))


@query(f"""WITH RECURSIVE {_GROUPS_SQL}, q AS (SELECT label, gene FROM mem WHERE species = 'src1'),
known AS (SELECT label, bit_or(1::BIGINT << substr(species, 4)::INTEGER) AS p, count(DISTINCT species) AS n FROM mem WHERE species <> 'src1' GROUP BY label),
{_TREE_SQL}, best AS (SELECT label, node_id, n FROM known JOIN tree ON p & profile = p QUALIFY row_number() OVER (PARTITION BY label ORDER BY depth DESC, node_id DESC) = 1)
SELECT gene, label, node_id::INTEGER AS taxon, (n - 1)::BIGINT AS score FROM q JOIN best USING (label)""")
def taxmap(spark, d):
    """Genes of a species of unknown place, at the least taxon of the other species of their group."""
    rows = _members(spark, d)
    known = rows.filter("species <> 'src1'").withColumn("no", F.substr("species", F.lit(4)).cast("int"))
    known = known.groupBy("label").agg(profiles.union(profiles.bit(F.col("no"))).alias("p"), (F.countDistinct("species") - 1).alias("score"))
    placed = taxonomy.least_taxon(known, _tree(spark, d), "p")
    return rows.filter("species = 'src1'").select("gene", "label").join(placed, "label").select("gene", "label", F.col("taxon").cast("int").alias("taxon"), "score")


def _plain_members(spark, d):
    return _members(spark, d).select(F.col("label").alias("cluster"), "species", F.col("gene").cast("string").alias("gene"), F.lit(1).alias("dom"), F.lit(1).alias("from"), F.col("length").alias("to"))


@query(f"""WITH RECURSIVE {_GROUPS_SQL} SELECT label AS cluster, 'Cluster ' || label || chr(10) || string_agg(species || ':' || gene || ' 1 ' || length, chr(10) ORDER BY species, gene::VARCHAR) || chr(10) AS value FROM mem GROUP BY label""")
def block_text(spark, d):
    return sinks.blocks(_plain_members(spark, d))


@query(f"WITH RECURSIVE {_GROUPS_SQL} SELECT label || ' ' || species || ':' || gene || ' 1 1 ' || length AS value FROM mem")
def flat_text(spark, d):
    return sinks.flat(_plain_members(spark, d))


@query("WITH RECURSIVE " + _GROUPS_SQL + " SELECT '<tr><td>' || label || '</td>' || " + " || ".join(f"'<td>' || coalesce(string_agg(species || ':' || gene, ' ' ORDER BY species || ':' || gene) FILTER (species = '{s}'), '') || '</td>'" for s in SPECIES) + " || '</tr>' AS value FROM mem GROUP BY label")
def html_table(spark, d):
    return sinks.html(sinks.table(_plain_members(spark, d), SPECIES))


@query(f"""WITH {HITS_SQL} SELECT id1, id2, CASE WHEN score > 20 THEN id2 ELSE id1 END AS first, score::INTEGER // 2 AS half FROM hits WHERE id1 IN (SELECT id1 FROM hits WHERE score > 20)""")
def reorient(spark, d):
    """Hits of genes that have a strong hit, seen from either side by score."""
    h = _long(spark, d).select("id1", "id2", "score")
    strong = h.filter("score > 20").select("id1").distinct()
    return h.join(strong, "id1", "left_semi").select("id1", "id2", F.when(F.col("score") > 20, F.col("id2")).otherwise(F.col("id1")).alias("first"), F.floor(F.col("score") / 2).cast("int").alias("half"))


