"""Registered queries of the subpackage: each applies one operator to its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlens.llm import align, chat, decontam, embed_dedup, mixing, pii, quality, secrets, simhash, substring, tokens, trie, warc
from arborlens.llm.work import new_path, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    records = warc.read_warc(spark, path, payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.format_and_read(turns.unionByName(own)).drop("n_windows")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    every = F.array_sort(F.concat("base", "found"))
    return found.select("doc_id", *[c.alias(n) for n, c in pii.counts(F.col("base")).items()], F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"), pii.spans_text(every).alias("spans"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.numbered_turns(table(spark, sf_dir, "conversations"))
    return trie.prefix_trie(trie.with_shared_openings(turns))


def op12_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    tokens.write_tokens(table(spark, sf_dir, "documents"), path)
    return tokens.read_documents(spark, path)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignments(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY sha1(html)) AS first FROM p),
c AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT)) AS parts FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> s) & 31 AS INTEGER) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM c
"""

OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), reach AS (
  SELECT vec_id AS node, vec_id AS root FROM embeddings
  UNION
  SELECT links.u, reach.root FROM links JOIN reach ON links.v = reach.node
), low AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
n AS (SELECT u, count(DISTINCT v) AS n FROM links GROUP BY u)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, low.root AS component_id, low.root = e.vec_id AS kept
FROM embeddings e JOIN low ON low.node = e.vec_id LEFT JOIN n ON n.u = e.vec_id
"""

OP5_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s
), k AS (
  SELECT *, CAST(2 * source_size AS DOUBLE) / w AS level_at,
    row_number() OVER (ORDER BY CAST(2 * source_size AS DOUBLE) / w, source) AS n,
    sum(source_size) OVER () AS total
  FROM w
), levels AS (  -- the level if exactly the n - 1 sources with the lowest ceilings stop at them
  SELECT n, level_at, (1.5 * CAST(total AS DOUBLE)
      - CAST(coalesce(sum(2 * source_size) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
      / CAST(sum(w) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM k
), l AS (
  SELECT level FROM levels WHERE level <= level_at ORDER BY n LIMIT 1
), t AS (
  SELECT w.source, w.source_size, least(w.w * l.level, CAST(2 * w.source_size AS DOUBLE)) AS target FROM w, l
), kinds AS (
  SELECT source, size, CAST(sum(size) AS BIGINT) AS words, CAST(floor(sqrt(CAST(size AS DOUBLE)) * 1000.0) AS BIGINT) AS appeal, count(*) AS n
  FROM d WHERE size > 0 GROUP BY source, size
), lv AS (  -- the level if exactly the longer documents are taken twice
  SELECT k.source, size, appeal,
    (t.target - 2 * CAST(coalesce(sum(words) OVER (PARTITION BY k.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(appeal * size * n) OVER (PARTITION BY k.source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM kinds k JOIN t ON k.source IS NOT DISTINCT FROM t.source
), lo AS (
  SELECT source, arg_max(level, size) AS level FROM lv WHERE appeal * level <= 2 GROUP BY source
), e1 AS (
  SELECT d.doc_id, d.size, d.u, t.source, t.source_size, t.target,
    CASE WHEN t.source_size > 0 AND t.target >= 2 * t.source_size THEN 2.0
      ELSE least(coalesce(floor(sqrt(CAST(d.size AS DOUBLE)) * 1000.0) * coalesce(lo.level, 0.0), 0.0), 2.0) END AS c
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN lo ON lo.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, CAST(floor(c) AS BIGINT) AS whole, c - floor(c) AS p FROM e1
), x AS (
  SELECT *, target - CAST(sum(size * whole) OVER (PARTITION BY source) AS BIGINT) AS rest, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM q
), o AS (
  SELECT *, coalesce(odds / (1 + odds), 1.0) AS r, row_number() OVER (PARTITION BY source ORDER BY coalesce(odds / (1 + odds), 1.0), doc_id, size) AS place
  FROM x
), c AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY place) AS BIGINT) AS upto FROM o
), g AS (
  SELECT *, p > 0 AND upto <= rest AS picked,
    rest - coalesce(max(CASE WHEN p > 0 AND upto <= rest THEN upto END) OVER (PARTITION BY source), 0) AS gap
  FROM c
), f AS (
  SELECT *, NOT picked AND p > 0 AND abs(gap - size) < gap AS near FROM g
), e AS (
  SELECT *, near AND row_number() OVER (PARTITION BY source, near ORDER BY abs(gap - size), place) = 1 AS closing FROM f
)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size > 0 THEN size * (whole + CASE WHEN picked OR closing THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS taken FROM e
"""

OP11_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), k AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, max(place) AS n,
    xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
      lambda a, b: list_reduce([xor(a, b)] || range(8), lambda r, i: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295::BIGINT) % 6 AS h
  FROM t GROUP BY conv_id
), c AS (
  SELECT k.conv_id, k.base, k.h, k.n, least(k.h, coalesce(b.n, 0)) AS taken FROM k LEFT JOIN k b ON k.base = b.conv_id
), walk AS (
  SELECT conv_id, taken + place - h AS depth, role, text FROM t JOIN c USING (conv_id) WHERE place > h
  UNION ALL
  SELECT c.conv_id, place, role, text FROM t JOIN c ON t.conv_id = c.base WHERE place <= h
), named AS (
  SELECT conv_id, depth, length(text) AS size, array_to_string(list(md5(length(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY depth), ',') AS name FROM walk
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM c
), step AS (
  SELECT *, lag(name) OVER (PARTITION BY conv_id ORDER BY depth) AS above, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM named
), node AS (
  SELECT name, any_value(above) AS above, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM step GROUP BY name
), child AS (
  SELECT above, count(*) AS n FROM node WHERE above IS NOT NULL GROUP BY above
), below AS (  -- every node with each node on the way to it
  SELECT s.name AS top, (n.n_convs - 1) * n.size AS saved, child.n IS NULL AS leaf
  FROM node n JOIN step s ON s.conv_id = n.conv_id AND s.depth <= n.depth LEFT JOIN child ON child.above = n.name
), total AS (
  SELECT top, CAST(sum(saved) AS BIGINT) AS saved, count(*) FILTER (WHERE leaf) AS leaves FROM below GROUP BY top
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(child.n, 0) AS n_children, total.leaves AS n_leaves,
  total.saved AS saved_tokens, n.ends_sha256
FROM node n LEFT JOIN node p ON p.name = n.above LEFT JOIN child ON child.above = n.name JOIN total ON total.top = n.name
"""

QUERIES = {
    "op1_warc": op1_warc,
    "op2_decontamination": op2_decontamination,
    "op3_chat_windows": op3_chat_windows,
    "op4_pii": op4_pii,
    "op5_mixing": op5_mixing,
    "op6_secrets": op6_secrets,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_quality": op9_quality,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_token_output": op12_token_output,
    "op13_token_alignment": op13_token_alignment,
}
ORACLE_SQL = {"op1_warc": OP1_SQL, "op5_mixing": OP5_SQL, "op7_embedding_dedup": OP7_SQL, "op11_prefix_trie": OP11_SQL}
