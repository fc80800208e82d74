"""The queries of the training-data operators, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, htmltext, langid, minhash, mixing, sharding, tokenbin, topk, toxicity, urlfilter
from .common import table

#: Production parameters of op1.
MIX = mixing.Mix(
    weights={"domain": {"domain0": 4, "domain1": 3, "domain2": 2}, "language": {"en": 6, "de": 2, "fr": 2}, "source": {"src0": 2}},
    share_percent=60, max_epochs=2, seed=7,
)
#: Of the pipeline's mixing stage: no document twice.
PIPELINE_MIX = mixing.Mix(weights=MIX.weights, share_percent=80, max_epochs=1, seed=7)
RULES = [
    urlfilter.Rule("block", "com/en/"), urlfilter.Rule("allow", "example.com/en/7"), urlfilter.Rule("allow", "net/de/"),
    urlfilter.Rule("block", "example.net/de/8"), urlfilter.Rule("block", "org/es/"),
]
SHARDS = 24
TOKENIZER = "word_bpe_49k.json"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cuts = mixing.plan(table(spark, sf_dir, "documents"), MIX)
    return mixing.selection(rows, cuts, MIX).select(
        "doc_id", F.col("l_domain").alias("domain"), F.col("l_language").alias("language"), F.col("l_source").alias("source"),
        F.col("tokens").alias("n_tokens"), F.col("budget").alias("leaf_budget"), "copies", "partial_tokens",
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_token_binary(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    return tokenbin.round_trip(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path(TOKENIZER))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"), null_ids=True)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.divisible(table(spark, sf_dir, "embeddings"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    bad = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return urlfilter.judge(table(spark, sf_dir, "pages"), bad, RULES).select(
        "page_id", "host", "path", "rule", "verdict", F.round("bad_mean", 6).alias("bad_mean"), F.round("bad_lower", 6).alias("bad_lower"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(table(spark, sf_dir, "pages"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(table(spark, sf_dir, "documents"), sharding.Tree(SHARDS), sharding.Tree(SHARDS + 1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_mixing, op2_decontamination, op3_toxicity, op4_token_binary, op5_minhash, op6_topk, op7_language, op8_url_filter, op9_html_text, op10_sharding)
    return {f.__name__: f for f in ops}


def _fill_sql(depth: int, level: str, weights: dict[str, int]) -> str:
    """One level of the budget tree, from table b{depth} to b{depth + 1}."""
    names = ["l_domain", "l_language", "l_source"][: depth + 1]
    kin = ", ".join(names[:-1]) or "1"
    weight = "CASE " + " ".join(f"WHEN {names[-1]} = '{k}' THEN {w}" for k, w in weights.items()) + " ELSE 1 END"
    node = ", ".join(names)
    same = " AND ".join(f"t.{n} IS NOT DISTINCT FROM s.{n}" for n in names)
    return f"""
n{depth} AS (SELECT {node}, {weight} AS w, sum(capacity) AS cap, any_value(budget) AS given FROM b{depth} GROUP BY {node}),
r{depth} AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY {kin} ORDER BY cap::DOUBLE / w, {names[-1]} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c_past,
  sum(w) OVER (PARTITION BY {kin} ORDER BY cap::DOUBLE / w, {names[-1]} NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest FROM n{depth}),
f{depth} AS (SELECT *, cap::HUGEINT * w_rest <= (given - c_past)::HUGEINT * w AS isfull FROM r{depth}),
s{depth} AS (SELECT *, coalesce(sum(CASE WHEN isfull THEN cap END) OVER (PARTITION BY {kin}), 0) AS c_full,
  coalesce(sum(CASE WHEN NOT isfull THEN w END) OVER (PARTITION BY {kin}), 0) AS w_open FROM f{depth}),
b{depth + 1} AS (SELECT t.l_domain, t.l_language, t.l_source, t.tokens, t.capacity,
  CASE WHEN s.isfull THEN s.cap ELSE ((s.given - s.c_full)::HUGEINT * s.w) // nullif(s.w_open, 0) END AS budget
  FROM b{depth} t JOIN s{depth} s ON {same}),"""


def _mixing_sql() -> str:
    fills = "".join(_fill_sql(d, n, MIX.weights.get(n, {})) for d, n in enumerate(("domain", "language", "source")))
    return f"""
WITH d AS (SELECT doc_id, 'domain' || (try_cast(regexp_extract(source, '[0-9]+$') AS BIGINT) % 4) AS l_domain, lang AS l_language, source AS l_source,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda x: x <> ''))::BIGINT AS tokens FROM documents),
leaf AS (SELECT l_domain, l_language, l_source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
b0 AS (SELECT *, tokens * {MIX.max_epochs} AS capacity, least((sum(tokens) OVER ()) * {MIX.share_percent} // 100, (sum(tokens) OVER ()) * {MIX.max_epochs})::BIGINT AS budget FROM leaf),{fills}
g AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole FROM b3),
h AS (SELECT l_domain, l_language, l_source, tokens AS leaf_tokens, budget, whole, budget - whole * tokens AS part FROM g),
k AS (SELECT d.*, h.budget, h.whole, h.part, md5('{MIX.seed}|' || h.whole::BIGINT || '|' || coalesce(d.doc_id::VARCHAR, 'null')) AS key FROM d JOIN h
  ON d.l_domain IS NOT DISTINCT FROM h.l_domain AND d.l_language IS NOT DISTINCT FROM h.l_language AND d.l_source IS NOT DISTINCT FROM h.l_source),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY l_domain, l_language, l_source ORDER BY key, doc_id) AS upto,
  sum(tokens) OVER (PARTITION BY l_domain, l_language, l_source, key, doc_id) AS own FROM k)
SELECT doc_id, l_domain AS domain, l_language AS language, l_source AS source, tokens AS n_tokens, budget::BIGINT AS leaf_budget,
  (whole + CASE WHEN part > 0 AND upto - own < part THEN 1 ELSE 0 END)::BIGINT AS copies,
  (CASE WHEN part > 0 AND upto - own < part THEN greatest(0, tokens - greatest(0, upto - part)) ELSE 0 END)::BIGINT AS partial_tokens FROM c"""


_DECONTAM_SQL = """
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bm AS (SELECT item_id, w, least(13, len(w)) AS m FROM bw WHERE len(w) > 0),
pat AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS p FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM bm)),
lens AS (SELECT DISTINCT m FROM pat),
pos AS (SELECT r, m, i, array_to_string(w[i : i + m - 1], ' ') AS p FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, lens WHERE len(w) >= m)),
occ AS (SELECT pos.r, pos.i, pos.m, pat.item_id FROM pos JOIN pat USING (m, p)),
hit AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + m)) AS j FROM occ) GROUP BY r),
ids AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM occ) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(ids.n, 0)::BIGINT AS n_items, sha256(coalesce(ids.s, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated FROM dw LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)"""

_TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0)))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""


def _url_sql() -> str:
    f = urlfilter
    two = ", ".join(f"'{x}'" for x in f.TWO_LEVEL)
    levels, prior = "", "(SELECT rate FROM top)"
    for k, level in enumerate(("suffix", "domain", "host")):
        levels += f"""
l{k} AS (SELECT {level} AS id, sum(n) AS n, sum(bad) AS bad FROM o{k} GROUP BY {level}),
f{k} AS (SELECT sum(l.n * (l.bad / l.n - rate) * (l.bad / l.n - rate)) AS ss, count(*) AS c, sum(l.n) AS n, any_value(rate) AS rate FROM l{k} l, top WHERE l.n > 0),
t{k} AS (SELECT CASE WHEN coalesce(n, 0) = 0 THEN {f.MAX_STRENGTH} WHEN round(ss / n, 9) - rate * (1 - rate) * c / n > 0 THEN
  greatest({f.MIN_STRENGTH}, least({f.MAX_STRENGTH}, (rate * (1 - rate) - round(ss / n, 9)) / (round(ss / n, 9) - rate * (1 - rate) * c / n))) ELSE {f.MAX_STRENGTH} END::DOUBLE AS strength FROM f{k}),
o{k + 1} AS (SELECT o.host, o.suffix, o.domain, o.n, o.bad, (l.bad + o.mean * strength) / (l.n + strength) AS mean, l.n + strength AS total FROM o{k} o JOIN l{k} l ON o.{level} = l.id, t{k}),"""
    rules = sorted(RULES, key=lambda r: (-len(r.text), r.text))
    fit = "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text}'" for r in rules) + " END"
    says = "CASE " + " ".join(f"WHEN rule = '{r.text}' THEN '{r.verdict}'" for r in RULES) + f" WHEN lower > {f.THRESHOLD} THEN 'block' ELSE 'allow' END"
    return f"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
k AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, count(k.page_id) AS n, coalesce(sum(k.bad), 0) AS bad FROM p LEFT JOIN k USING (page_id) GROUP BY host),
top AS (SELECT (coalesce(sum(bad), 0) + {f.PRIOR[0]}::DOUBLE) / (coalesce(sum(n), 0) + {sum(f.PRIOR)}::DOUBLE) AS rate FROM h),
x AS (SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS two FROM h),
o0 AS (SELECT host, CASE WHEN two IN ({two}) THEN two ELSE string_split(host, '.')[-1] END AS suffix,
  CASE WHEN two IN ({two}) THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE two END AS domain, n::DOUBLE AS n, bad::DOUBLE AS bad, rate AS mean, 0::DOUBLE AS total FROM x, top),{levels}
z AS (SELECT host, mean, mean - {f.Z} * sqrt(mean * (1 - mean) / (total + 1)) AS lower FROM o3),
y AS (SELECT page_id, host, path, {fit} AS rule, mean, lower FROM p JOIN z USING (host))
SELECT page_id, host, path, rule, {says} AS verdict, round(mean, 6) AS bad_mean, round(lower, 6) AS bad_lower FROM y"""


def _crc_table() -> list[int]:
    """The remainders of all bytes by the polynomial of crc32."""
    out = []
    for v in range(256):
        for _ in range(8):
            v = v >> 1 ^ (0xEDB88320 if v & 1 else 0)
        out.append(v)
    return out


def _crc_sql(text: str) -> str:
    """crc32 of a string's bytes, unsigned."""
    listed = "[" + ", ".join(map(str, _crc_table())) + "]"
    bytes_ = f"list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex({text}), '..'), lambda x: ('0x' || x)::BIGINT))"
    return f"xor(4294967295, list_reduce({bytes_}, lambda c, x: xor(c >> 8, ({listed}::BIGINT[])[(xor(c, x) & 255) + 1])))"


def _language_sql() -> str:
    """Valid where no language has more than SAMPLE_DOCS rows to learn from: the sample is then all of them."""
    p = langid
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, text IS NOT NULL AS has, lower(coalesce(text, '')) AS t, coalesce({_crc_sql("coalesce(doc_id::VARCHAR, '')")} % 4 = 2 AND doc_id IS NOT NULL, false) AS held_out FROM documents),
w AS (SELECT r, word, count(*) AS k FROM (SELECT r, regexp_replace(unnest(regexp_split_to_array(t, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')), '[^\\p{{L}}]', '', 'g') AS word FROM d) WHERE word <> '' GROUP BY ALL),
x AS (SELECT word, substr(w, i, n) AS gram, count(*) AS m FROM (SELECT word, '_' || word || '_' AS w, n, unnest(range(1, length(word) + 4 - n)) AS i FROM (SELECT DISTINCT word FROM w), range(1, {p.GRAMS + 1}) AS s(n)) WHERE substr(w, i, n) <> '_' GROUP BY ALL),
g AS (SELECT r, gram, sum(k * m) AS n FROM w JOIN x USING (word) GROUP BY ALL),
f AS (SELECT DISTINCT ON (lang, doc_id, t) r, lang FROM d WHERE NOT held_out AND lang IS NOT NULL AND has),
z AS (SELECT lang, count(*) AS n FROM d WHERE NOT held_out AND lang IS NOT NULL AND has GROUP BY lang),
prof AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, gram) - 1 AS place FROM g JOIN f USING (r) GROUP BY lang, gram QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, gram) <= {p.PROFILE}),
top AS (SELECT r, gram, row_number() OVER (PARTITION BY r ORDER BY n DESC, gram) - 1 AS own FROM g WHERE gram IN (SELECT gram FROM prof) QUALIFY row_number() OVER (PARTITION BY r ORDER BY n DESC, gram) <= {p.TOP}),
far AS (SELECT r, z.lang, z.n, count(*) AS m, sum(CASE WHEN place IS NULL THEN {p.PROFILE} ELSE abs(place - own) END)::BIGINT AS dist FROM top CROSS JOIN z LEFT JOIN prof ON prof.lang = z.lang AND prof.gram = top.gram GROUP BY ALL),
best AS (SELECT r, lang, greatest(0.0::DOUBLE, 1.0::DOUBLE - dist / ({p.PROFILE} * m)::DOUBLE) AS score FROM far QUALIFY row_number() OVER (PARTITION BY r ORDER BY dist, n DESC, lang) = 1)
SELECT doc_id, held_out, CASE WHEN r NOT IN (SELECT r FROM w) THEN 'und' ELSE coalesce(best.lang, (SELECT lang FROM z ORDER BY n DESC, lang LIMIT 1), 'und') END AS lang_pred, coalesce(score, 0.0::DOUBLE) AS score FROM d LEFT JOIN best USING (r)"""


def _descent_sql(name: str, tree: sharding.Tree) -> str:
    """Common table expressions that end in ``name`` (key, leaf): the first draw that counts, of every key."""
    if tree.weights:
        raise ValueError("SQL for equal weights only")
    ps = ", ".join(f"('{p['name']}', {p['region']}, {p['regions']}, {p['floor']}::DOUBLE, {p['width']}::DOUBLE, {p['rate']}::DOUBLE)" for p in tree.processes())
    part = lambda start, n: f"(('0x' || substr(h, {start}, {n}))::BIGINT / {16**n}::DOUBLE)"
    wait = f"-ln({part(1, 13)} + {0.5 / 16**13!r}::DOUBLE)"
    return f"""
{name}_p(name, region, regions, floor, width, rate) AS (VALUES {ps}),
{name}_d AS (SELECT key, p.*, j, md5(p.name || '|' || j || '|' || key) AS h FROM (SELECT DISTINCT key FROM d), {name}_p p, range({sharding.TRIES}) AS t(j)),
{name}_t AS (SELECT key, name, j, sum({wait} / rate) OVER (PARTITION BY key, name ORDER BY j ROWS UNBOUNDED PRECEDING) AS t, floor + width * {part(28, 5)} AS level,
  ((region + floor({part(14, 6)} * regions)::INTEGER) * {tree.racks_per_region} + floor({part(20, 4)} * {tree.racks_per_region})::INTEGER) * {tree.per_rack} + floor({part(24, 4)} * {tree.per_rack})::INTEGER AS leaf FROM {name}_d),
{name}_f AS (SELECT key, t, leaf FROM {name}_t WHERE leaf < {tree.shards} AND level < 1 QUALIFY row_number() OVER (PARTITION BY key ORDER BY t) = 1),
{name}_l AS (SELECT key, {wait} AS t, leaf FROM (SELECT key, leaf, md5('{tree.seed}|leaf|' || leaf || '|' || key) AS h FROM (SELECT DISTINCT key FROM d WHERE key NOT IN (SELECT key FROM {name}_f)), range({tree.shards}) AS l(leaf))
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY t) = 1),
{name} AS (SELECT key, leaf FROM {name}_f UNION ALL SELECT key, leaf FROM {name}_l),"""


def _sharding_sql() -> str:
    tree, grown = sharding.Tree(SHARDS), sharding.Tree(SHARDS + 1)
    return f"""
WITH c AS (SELECT doc_id, (strlen(coalesce(text, '')) + 8)::BIGINT AS size, {_crc_sql("coalesce(text, '')")} AS text_crc32 FROM documents),
d AS (SELECT *, CASE WHEN doc_id IS NULL THEN 'null ' || text_crc32 ELSE doc_id::VARCHAR END AS key FROM c),{_descent_sql('now', tree)}{_descent_sql('more', grown)}
z AS (SELECT d.*, now.leaf AS shard, more.leaf AS grown_shard, md5('{tree.seed}|slot|' || key || '|' || text_crc32) AS h FROM d JOIN now USING (key) JOIN more USING (key))
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard, (row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot, grown_shard::INTEGER AS grown_shard,
  (shard // {tree.per_rack * tree.racks_per_region})::INTEGER AS region, (shard // {tree.per_rack})::INTEGER AS rack FROM z"""


def oracle_sql() -> dict[str, str]:
    return {"op7_language": _language_sql(), "op10_sharding": _sharding_sql(), "op1_mixing": _mixing_sql(), "op2_decontamination": _DECONTAM_SQL, "op6_topk": _TOPK_SQL, "op8_url_filter": _url_sql()}
