"""Queries of domain matches, other names, tree labels, moved regions, connection counts, numbering by families and outgroups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import measures, profiles, regions
from ..operators import edges, groups, subgroups, taxonomy
from ..operators import select as select_
from ..params import Params
from ..sources import bridge
from ..storage import table
from .catalogue import _GROUPS_SQL, GENES_SQL, HITS_SQL, LONG_SQL, RICH, STRICT, _hits, _labels, _long, _members, labels_sql, query
from .more import _packed

_SPANS_SQL = f"""{HITS_SQL}, {labels_sql(STRICT, 'a')}, {labels_sql(RICH, 'b')},
side AS (SELECT id1 AS gene, from1 AS f, to1 AS t, score FROM hits UNION ALL SELECT id2, from2, to2, score FROM hits),
ours AS (SELECT gene, label, min(f) AS f, max(t) AS t FROM side JOIN a ON id = gene WHERE score >= {STRICT} GROUP BY gene, label),
theirs AS (SELECT gene, label, min(f) AS f, max(t) AS t FROM side JOIN b ON id = gene WHERE score >= {RICH} GROUP BY gene, label),
n1 AS (SELECT label, count(*) AS n1 FROM ours GROUP BY label), n2 AS (SELECT label AS other, count(*) AS n2 FROM theirs GROUP BY label),
met AS (SELECT o.label, t.label AS other, count(DISTINCT (o.gene, o.f, o.t)) AS common FROM ours o JOIN theirs t ON o.gene = t.gene
  AND least(o.t, t.t) - greatest(o.f, t.f) > (least(o.t - o.f, t.t - t.f) + 1) * 0.9::DOUBLE GROUP BY ALL)"""


def _spans(spark, d, least):
    s = edges.mirrored(_hits(spark, d).filter(F.col("score") >= least)).select(F.col("id").alias("gene"), "from", "to")
    labelled = s.join(_labels(spark, d, least).select(F.col("id").alias("gene"), "label"), "gene")
    return labelled.groupBy("gene", "label").agg(F.min("from").alias("from"), F.max("to").alias("to"))


@query(f"""WITH RECURSIVE {_SPANS_SQL} SELECT label, other AS best, common::BIGINT AS common, round(common / (n1 + n2 - common)::DOUBLE, 9) AS jaccard FROM met JOIN n1 USING (label) JOIN n2 USING (other)
QUALIFY row_number() OVER (PARTITION BY label ORDER BY common / (n1 + n2 - common)::DOUBLE DESC, other) = 1""")
def domain_match(spark, d):
    """Strict groups and the rich groups that are closest, where a gene counts if its aligned parts overlap."""
    return groups.best_match_domains(_spans(spark, d, STRICT), _spans(spark, d, RICH), 0.9).select("label", "best", "common", F.round("jaccard", 9).alias("jaccard"))


@query(f"""WITH RECURSIVE {_GROUPS_SQL}, x AS (SELECT doc_id AS gene, 'X' || doc_id AS name FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'Y' || doc_id FROM documents WHERE doc_id % 5 = 0)
SELECT label, coalesce(name, gene::VARCHAR) AS gene, species FROM mem LEFT JOIN x USING (gene)""")
def cross_names(spark, d):
    docs = table(spark, d, "documents")
    key = F.col("doc_id").cast("string")
    names = docs.filter("lang = 'en'").select(key.alias("gene"), F.concat(F.lit("X"), key).alias("name")).union(docs.filter("doc_id % 5 = 0").select(key, F.concat(F.lit("Y"), key)))
    return groups.cross_named(_members(spark, d).select("label", F.col("gene").cast("string").alias("gene"), "species"), names).select("label", "gene", "species")


@query("""WITH t AS (SELECT 0 AS node, NULL::INTEGER AS parent, 'all' AS label, NULL::VARCHAR AS species UNION ALL SELECT 1 + r_regionkey, 0, r_name, NULL FROM region
  UNION ALL SELECT 100 + n_nationkey, 1 + n_regionkey, NULL, n_name FROM nation UNION ALL SELECT 900, 999, NULL, 'lone' UNION ALL SELECT 999, 0, 'named above', NULL),
k AS (SELECT parent, count(*) AS kin FROM t GROUP BY parent)
SELECT t.node::INTEGER AS node, coalesce(CASE WHEN t.species IS NOT NULL AND t.label IS NULL AND kin = 1 THEN p.label END, t.label, t.species) AS name FROM t LEFT JOIN t p ON p.node = t.parent LEFT JOIN k ON k.parent = t.parent""")
def tree_labels(spark, d):
    none, text = F.lit(None).cast("int"), F.lit(None).cast("string")
    r = table(spark, d, "region").select((F.col("r_regionkey") + 1).cast("int").alias("node_id"), F.lit(0).alias("parent_id"), F.col("r_name").alias("label"), text.alias("species"))
    n = table(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("int"), (F.col("n_regionkey") + 1).cast("int"), text, "n_name")
    one = spark.range(1)
    top = one.select(F.lit(0), none, F.lit("all"), text).union(one.select(F.lit(900), F.lit(999), text, F.lit("lone"))).union(one.select(F.lit(999), F.lit(0), F.lit("named above"), text))
    return taxonomy.labels(r.union(n).union(top)).select(F.col("node_id").alias("node"), "name")


@query(f"""WITH {LONG_SQL} SELECT id1, id2, from1 + 100 AS moved_from, to1 + 100 AS moved_to, length1 - to1 + 1 AS turned_from, length1 - from1 + 1 AS turned_to FROM long""")
def region_moves(spark, d):
    """Regions moved along their gene, and numbered from its other end."""
    f, t = F.col("from1"), F.col("to1")
    (a, b), (c, e) = regions.shifted(f, t, F.lit(100)), regions.reversed_(f, t, F.col("length1"))
    return _long(spark, d).select("id1", "id2", a.alias("moved_from"), b.alias("moved_to"), c.alias("turned_from"), e.alias("turned_to"))


@query(f"""WITH {HITS_SQL}, deg AS (SELECT g, count(*) AS n FROM (SELECT id1 AS g FROM hits UNION ALL SELECT id2 FROM hits) GROUP BY g),
hub AS (SELECT g FROM deg ORDER BY n DESC, g LIMIT 2), m AS (SELECT id1 AS id, id2 AS other, score FROM hits UNION ALL SELECT id2, id1, score FROM hits)
SELECT other AS third, least(sum(score * 100), 65535)::INTEGER AS links, sum(score)::BIGINT AS score_sum FROM m WHERE id IN (SELECT g FROM hub) AND other NOT IN (SELECT g FROM hub) GROUP BY other""")
def connection_count(spark, d):
    """Connections of the two genes with most hits to all others, as a merge of the two would count them."""
    h = _hits(spark, d)
    hub = [r[0] for r in edges.mirrored(h).groupBy("id").count().orderBy(F.desc("count"), "id").limit(2).collect()]
    return edges.connections(h.withColumn("links", F.col("score") * 100), *(hub + [None, None])[:2])


@query(f"""WITH RECURSIVE {HITS_SQL}, {labels_sql(STRICT, 'a')}, {labels_sql(RICH, 'b')}, met AS (SELECT DISTINCT a.label AS x, b.label AS y FROM a JOIN b ON a.id = b.id),
e AS (SELECT m.x AS p, n.x AS q FROM met m JOIN met n USING (y)), r(id, f) AS (SELECT p, p FROM e UNION SELECT e.q, r.f FROM r JOIN e ON e.p = r.id WHERE r.f < e.q),
fam AS (SELECT id AS label, min(f) AS family FROM r GROUP BY id) SELECT label, family, row_number() OVER (ORDER BY family, label)::INTEGER AS place FROM fam""")
def family_order(spark, d):
    """Strict groups in the order of their families."""
    return groups.numbered(subgroups.unions(_labels(spark, d, STRICT), _labels(spark, d, RICH)), "place", F.asc("family"), F.asc("label"))


_OUT = ["src0", "src1", "src2"]


@query(f"""WITH {LONG_SQL}, e AS (SELECT id1, id2, species1, species2, score FROM long WHERE score >= 3)
SELECT id1, id2, score + CASE WHEN species1 = species2 THEN 0.025::DOUBLE WHEN (species1 IN ('src0', 'src1', 'src2')) <> (species2 IN ('src0', 'src1', 'src2')) THEN -0.025::DOUBLE ELSE 0 END AS score FROM e""")
def outgroup_edges(spark, d):
    """The edges that clustering starts from, with ties corrected within species and across the outgroup's border."""
    genes, hits = bridge.kept(spark, d)
    return edges.edges_of(hits, genes, Params(cutoff=4.0, miss_score=3.0), _OUT).select("id1", "id2", "score")


@query("""WITH tree AS (SELECT 0 AS id, NULL::INTEGER AS up, bit_or(1::BIGINT << n_nationkey) AS profile FROM nation
  UNION ALL SELECT 1 + n_regionkey, 0, bit_or(1::BIGINT << n_nationkey) FROM nation GROUP BY n_regionkey UNION ALL SELECT 100 + n_nationkey, 1 + n_regionkey, 1::BIGINT << n_nationkey FROM nation),
t AS (SELECT a.profile, b.profile AS above FROM tree a LEFT JOIN tree b ON b.id = a.up), prof AS (SELECT c_custkey // 40 AS grp, bit_or(1::BIGINT << c_nationkey) AS p FROM customer GROUP BY 1)
SELECT grp::BIGINT AS grp, bit_count(p)::INTEGER AS species, count(*) FILTER (profile & p = profile AND NOT coalesce(above & p = above, false))::BIGINT AS subtrees FROM prof, t GROUP BY grp, p""")
def subtree_count(spark, d):
    """Of how many whole subtrees of the tree of nations the customers of a block come."""
    n = table(spark, d, "nation").withColumn("bit", profiles.bit(F.col("n_nationkey")))
    root = n.agg(profiles.union(F.col("bit")).alias("profile")).select(F.lit(0).alias("node_id"), F.lit(None).cast("int").alias("parent_id"), "profile")
    mid = n.groupBy("n_regionkey").agg(profiles.union(F.col("bit")).alias("profile")).select((F.col("n_regionkey") + 1).alias("node_id"), F.lit(0).alias("parent_id"), "profile")
    tree = root.union(mid).union(n.select((F.col("n_nationkey") + 100).alias("node_id"), (F.col("n_regionkey") + 1).alias("parent_id"), F.col("bit").alias("profile")))
    p = table(spark, d, "customer").groupBy(F.floor(F.col("c_custkey") / 40).cast("long").alias("grp")).agg(profiles.union(profiles.bit(F.col("c_nationkey"))).alias("p"))
    return taxonomy.subtree_counts(p, tree, "p").select("grp", profiles.count(F.col("p")).alias("species"), "subtrees")


@query(f"""WITH RECURSIVE {HITS_SQL}, {labels_sql(RICH)}, k AS (SELECT id FROM lab WHERE label % 3 = 1 OR label IN (SELECT label FROM lab WHERE id IN (SELECT min(id) FROM lab WHERE id % 2 = 0)))
SELECT h.id1, h.id2, h.score FROM hits h JOIN lab a ON a.id = h.id1 JOIN lab b ON b.id = h.id2 WHERE a.label = b.label AND h.id1 IN (SELECT id FROM k)""")
def extract_clusters(spark, d):
    """Hits inside some clusters, named by their labels and by one of their genes."""
    members = _members(spark, d).select("gene", "label")
    some = [r[0] for r in members.select("label").distinct().filter("label % 3 = 1").collect()]
    gene = members.filter("gene % 2 = 0").agg(F.min("gene")).first()[0]
    return edges.of_clusters(_hits(spark, d), members, some, None if gene is None else [gene]).select("id1", "id2", "score")


@query(f"""WITH {LONG_SQL}, p AS (SELECT id1, id2, score, from1, from2, (100 + (id1 * 7 + id2 * 13) % 200)::DOUBLE AS pam FROM long) SELECT id1, id2, score, pam, row_number() OVER (ORDER BY score DESC, pam, id1, id2, from1, from2)::INTEGER AS place FROM p""")
def hit_order(spark, d):
    """Hits by falling score."""
    return select_.by_score(_packed(spark, d)).select("id1", "id2", "score", "pam", "place")


@query(f"""WITH {HITS_SQL}, f AS (SELECT *, k AS file FROM hits, range(3) AS r(k) WHERE (id1 + k) % 3 <> 0)
SELECT file::BIGINT AS file, id1, id2, max(score + (id2 + file * 5) % 4)::BIGINT AS score FROM f GROUP BY file, id1, id2""")
def unique_by_file(spark, d):
    """The best hit of a pair in each of three files that hold many pairs alike, in either order and more than once."""
    h = _hits(spark, d)
    rows = h.withColumn("file", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)]))).filter((F.col("id1") + F.col("file")) % 3 != 0)
    rows = rows.withColumn("score", (F.col("score") + (F.col("id2") + F.col("file") * 5) % 4).cast("long"))
    less = rows.withColumn("score", F.col("score") - 1)
    turned = less.select("score", "file", F.col("id2").alias("id1"), F.col("id1").alias("id2"), F.col("from2").alias("from1"), F.col("to2").alias("to1"), F.col("from1").alias("from2"), F.col("to1").alias("to2"))
    packed = rows.unionByName(turned).withColumn("ident", F.lit(99.0)).withColumn("pam", F.lit(1.0)).withColumn("eval", F.lit(0.0))
    return select_.select(packed, select_.Selection(once_by=("file",))).select("file", "id1", "id2", "score")


@query("""WITH s AS (SELECT DISTINCT l_partkey // 10 AS part, s_nationkey * 5 AS k FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
w AS (SELECT part, k // 63 AS word, bit_or(1::BIGINT << (k % 63)) AS bits FROM s GROUP BY ALL), m AS (SELECT part, max(word) AS most FROM w GROUP BY part)
SELECT part, string_agg(coalesce(bits, 0)::VARCHAR, ' ' ORDER BY j) AS words FROM (SELECT m.part, j, bits FROM m JOIN range(2) AS r(j) ON j <= most LEFT JOIN w ON w.part = m.part AND w.word = j) GROUP BY part""")
def profile_words(spark, d):
    """Profiles over more species than a word has bits."""
    l, s = table(spark, d, "lineitem").select("l_partkey", "l_suppkey"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    sets = l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.floor(F.col("l_partkey") / 10).cast("long").alias("part")).agg(F.collect_set(F.col("s_nationkey") * 5).alias("k"))
    return sets.select("part", F.array_join(F.transform(profiles.words(F.col("k")), lambda x: x.cast("string")), " ").alias("words"))


@query(f"""WITH {GENES_SQL} SELECT species, (species LIKE 'src1%' OR species IN ('src3', 'src7')) AS inside FROM genes GROUP BY species""")
def species_groups(spark, d):
    """Species of a group that is declared by a prefix and a list."""
    names = [f"src{k}" for k in range(20)]
    mask = profiles.mask_of(names, ["src3", "src7", "unknown"], "src1")
    at = F.array_position(F.array(*map(F.lit, names)), F.col("species")) - 1
    return bridge.genes(table(spark, d, "documents")).select("species").distinct().select("species", (profiles.mask_status(profiles.bit(at), mask) > 0).alias("inside"))


@query(f"""WITH {HITS_SQL} SELECT id1, id2, printf('%.1f', score / 7::DOUBLE) AS one, printf('%.2f', score / 7::DOUBLE) AS two, trunc(score / 7::DOUBLE)::BIGINT::VARCHAR AS whole FROM hits WHERE score % 7 <> 0""")
def score_text(spark, d):
    v = F.col("score") / 7
    return _hits(spark, d).filter("score % 7 <> 0").select("id1", "id2", measures.formatted(v, "1").alias("one"), measures.formatted(v, "2").alias("two"), measures.formatted(v, "d").alias("whole"))
