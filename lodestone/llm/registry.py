"""The queries of this subpackage, one per operator with production parameters over
its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, chat, embeddings, exact_dedup, langid, mixing, neighbours, pii, simhash, tokenstore, trie, urlfilter
from .common import materialise, new_path

RULES: list[urlfilter.Rule] = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("allow", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: The list of the URL query: the canonical URLs of all pages on hosts with these names.
LISTED_NAMES = ("cheap-pills", "spam-farm")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return pii.span_digests(pii.find_pii(docs, pii.fit_field(docs)))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(_read(spark, sf_dir, "documents"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(_read(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_read(spark, sf_dir, "embeddings"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.format_conversations(turns.unionByName(extra)))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    network = langid.train(docs)
    rows = docs.select("doc_id", "text", (langid.fold(F.col("doc_id")) == 1).alias("held_out"))
    return langid.predict(rows, network).drop("text")


def op8_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    host, path = urlfilter.host_and_path(F.col("url"))
    bad = F.array(*[F.lit(n) for n in LISTED_NAMES])
    listed = pages.filter(F.arrays_overlap(F.split(host, r"\."), bad)).select(urlfilter.canonical(host, path).alias("listed"))
    return urlfilter.judge(pages, listed, RULES)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(_read(spark, sf_dir, "documents"))


def op10_tokenstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "store")
    tokenstore.write_store(_read(spark, sf_dir, "documents"), path)
    read = materialise(tokenstore.read_digests(spark, path), "store-read")
    tokenstore.forget(spark, path)
    return read


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = trie.branched(trie.conversation_paths(_read(spark, sf_dir, "conversations")))
    return trie.prefix_trie(paths).drop("node_id", "parent_id", "turn_id")


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_pii, op2_bpe, op3_mix, op4_simhash, op5_embeddings, op6_chat, op7_langid, op8_urlfilter, op9_exact_dedup, op10_tokenstore, op11_audit, op12_trie, op13_neighbours, pipeline]
    return {f.__name__: f for f in named}


SQL_OP3 = """
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5(concat('mix-1|', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS key
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM totals),
filled AS (SELECT *, 2 * source_size AS cap, 2 * source_size / CAST(weight AS DOUBLE) AS full_at FROM ranked),
sums AS (
  SELECT *, row_number() OVER (ORDER BY full_at, source ASC NULLS LAST) AS place,
    coalesce(sum(cap) OVER (ORDER BY full_at, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent,
    sum(weight) OVER (ORDER BY full_at, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
    1.5 * sum(source_size) OVER () AS budget
  FROM filled),
ends AS (SELECT *, (CAST(budget AS DOUBLE) - CAST(sent AS DOUBLE)) / CAST(open_weight AS DOUBLE) AS end_at FROM sums),
firsts AS (SELECT *, min(CASE WHEN end_at <= full_at THEN place END) OVER () AS first_place FROM ends),
ended AS (SELECT *, max(CASE WHEN place = first_place THEN end_at END) OVER () AS mix_end FROM firsts),
plan AS (
  SELECT source, source_size, CASE WHEN full_at <= mix_end THEN CAST(cap AS DOUBLE) ELSE weight * mix_end END AS target FROM ended),
placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(size, floor(target) - before)) + greatest(0, least(size, floor(target) - before - source_size)) AS BIGINT) AS taken
FROM placed
"""

SQL_OP8 = """
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut),
named AS (
  SELECT *, CASE WHEN host <> '' THEN concat(host, regexp_replace(path, '/+$', '')) END AS canonical,
    CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
         WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM parts),
listed AS (
  SELECT DISTINCT canonical FROM named
  WHERE list_has_any(string_split(host, '.'), ['cheap-pills', 'spam-farm']) AND canonical IS NOT NULL)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/7', 'example.net/de/8') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM named
"""

SQL_OP9 = """
WITH given AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
groups AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM given GROUP BY text)
SELECT g.doc_id, w.keep_id, w.group_size, g.doc_id IS NOT DISTINCT FROM w.keep_id AS kept, sha256(g.text) AS text_sha256
FROM given g JOIN groups w ON g.text = w.text
"""

SQL_OP11 = """
WITH given AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
marks AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
words AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM given),
fails AS (
  SELECT part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic,
    CAST(len(w) < 200 AS INT) AS a, CAST(100 * list_unique(w) < 50 * len(w) AS INT) AS b,
    CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS INT) AS c,
    CAST(regexp_matches(text, '[#$%&*|]') AS INT) AS d, CAST(coalesce(g.doc_id > least, false) AS INT) AS e
  FROM words g LEFT JOIN marks m ON g.doc_id = m.doc_id),
cells AS (
  SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM fails GROUP BY ALL),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(l, bit)),
orders AS (
  SELECT concat(p.l, q.l, r.l, s.l, t.l) AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM letters p, letters q, letters r, letters s, letters t WHERE p.bit | q.bit | r.bit | s.bit | t.bit = 31),
steps AS (
  SELECT filter_order, CAST(i AS INT) AS step, bits[i] AS own, coalesce(list_sum(bits[:i - 1]), 0)::INT AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS i)),
outcome AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (own | earlier) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & own > 0 AND mask & earlier > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM outcome
"""

SQL_OP12 = """
WITH placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)),
      lambda c, x: list_reduce(list_prepend(xor(c, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)),
      4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM placed)),
rebuilt AS (
  SELECT c.conv_id, p.pos, p.role, p.text FROM convs c JOIN placed p ON p.conv_id = c.base AND p.pos <= c.h
  UNION ALL SELECT c.conv_id, p.pos, p.role, p.text FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.pos > c.h),
keyed AS (
  SELECT conv_id, strlen(text) AS bytes, row_number() OVER w AS depth,
    sha256(string_agg(sha256(concat(strlen(role), ':', role, text)), '') OVER w) AS key
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
steps AS (
  SELECT conv_id, bytes, depth, key, coalesce(lag(key) OVER (PARTITION BY conv_id ORDER BY depth), '') AS above,
    lead(key) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends
  FROM keyed
  UNION ALL
  SELECT conv_id, 0, 0, '', NULL, NOT EXISTS (FROM keyed k WHERE k.conv_id = c.conv_id) FROM convs c),
nodes AS (
  SELECT key, depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS own,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM steps GROUP BY key, depth),
counts AS (SELECT above AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY above),
below AS (
  SELECT s.key, sum(n.own) AS saved, count(*) FILTER (WHERE c.key IS NULL) AS leaves
  FROM nodes n LEFT JOIN counts c ON c.key = n.key JOIN steps s ON s.conv_id = n.conv_id AND s.depth <= n.depth GROUP BY s.key)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, b.leaves AS n_leaves,
  CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.key = n.key LEFT JOIN counts c ON c.key = n.key LEFT JOIN nodes p ON p.key = n.above
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_mix": SQL_OP3, "op8_urlfilter": SQL_OP8, "op9_exact_dedup": SQL_OP9, "op11_audit": SQL_OP11, "op12_trie": SQL_OP12}
