"""Scalar functions: text, null, number, date, array, map, JSON and hash families."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlens.functions import confidence as conf
from arborlens.functions import text as T
from arborlens.plans.analogue import claims, occ, species, table, tile_maps
from arborlens.plans.registry import query


@query("SELECT taxon, regexp_replace(lower(family || ' ' || name), '[^a-z0-9 ]', '', 'g') AS plain FROM species")
def fn_plain_name(spark, d):
    return species(spark, d).select("taxon", T.plain_name(F.concat_ws(" ", "family", "name")).alias("plain"))


@query("SELECT taxon, split_part(native, ';', 1) AS head, regexp_replace(name || '-' || size, '-[0-9]+$', '') AS base, lpad(CAST(size AS VARCHAR), 3, '0') AS code, left(native, 8) AS short FROM species WHERE native IS NOT NULL")
def fn_text_parts(spark, d):
    s = species(spark, d).where("native is not null")
    base = F.regexp_replace(F.concat_ws("-", "name", F.col("size").cast("string")), "-[0-9]+$", "")
    return s.select("taxon", F.split_part("native", F.lit(";"), F.lit(1)).alias("head"), base.alias("base"), F.lpad(F.col("size").cast("string"), 3, "0").alias("code"), F.left("native", F.lit(8)).alias("short"))


@query()
def fn_parse_common_names(spark, d):
    """Names in the words of documents: line ends stand for semicolons."""
    blob = F.translate("text", "\n.", ";;")
    rows = table(spark, d, "documents").select("doc_id", F.explode(T.parse_common_names(blob)).alias("n"))
    return rows.select("doc_id", "n.name", "n.language_code", "n.position")


@query()
def fn_top_common_names(spark, d):
    return table(spark, d, "documents").select("doc_id", T.top_common_names(F.translate("text", "\n.", ";;")).alias("names"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{0400}-\\x{04FF}]') THEN 'ru' WHEN regexp_matches(text, '[\\x{3000}-\\x{9FFF}\\x{F900}-\\x{FAFF}]') THEN 'ja' WHEN regexp_matches(text, '[\\x{0600}-\\x{06FF}]') THEN 'ar' WHEN regexp_matches(text, '[\\x{0900}-\\x{097F}]') THEN 'hi' WHEN regexp_matches(text, '[\\x{0E00}-\\x{0E7F}]') THEN 'th' END AS script FROM documents")
def fn_script_language(spark, d):
    return table(spark, d, "documents").select("doc_id", T.script_language(F.col("text")).alias("script"))


@query("SELECT page_id, regexp_replace(split_part(regexp_replace(lower(url), '^[^/]*?://', ''), '/', 1), '^www\\.', '') AS domain FROM pages")
def fn_domain(spark, d):
    return table(spark, d, "pages").select("page_id", T.domain(F.col("url")).alias("domain"))


@query()
def fn_name_from_url(spark, d):
    return table(spark, d, "pages").select("page_id", T.name_from_url(F.col("url")).alias("name"))


@query("SELECT taxon, CASE WHEN taxon % 3 = 0 THEN habit_ai WHEN taxon % 5 = 0 THEN 'дуб ' || size WHEN taxon % 2 = 0 THEN name ELSE genus END AS display FROM species")
def fn_display_name(spark, d):
    """The name that research gave, else the first in Latin script, else the first."""
    t = F.col("taxon")
    other = F.concat(F.lit("дуб "), F.col("size").cast("string"))
    names = F.when(t % 5 == 0, F.array(other, F.lit("樫"))).when(t % 2 == 0, F.array(other, "name", "genus")).otherwise(F.array("genus", other))
    return species(spark, d).select("taxon", T.display_name(F.when(t % 3 == 0, F.col("habit_ai")), names).alias("display"))


@query("SELECT page_id, replace(url_encode(url || '?q=a b+c*d~é'), '%2F', '/') AS quoted FROM pages")
def fn_uri_quote(spark, d):
    return table(spark, d, "pages").select("page_id", T.uri_quote(F.concat("url", F.lit("?q=a b+c*d~é"))).alias("quoted"))


@query("SELECT id, CAST(floor(age / 86400000000) AS BIGINT) AS days, age > 31536000000000 AS stale FROM (SELECT id, epoch_us(TIMESTAMP '2025-06-01 00:00:00') - epoch_us(created) AS age FROM claims)")
def fn_as_of(spark, d):
    """Ages at a stated time in place of the clock's, so that a rerun agrees: whole days that have passed (a claim made later
    has a negative age), and whether it is more than 365 days, to the microsecond."""
    age = F.timestamp_diff("microsecond", F.col("created"), F.lit("2025-06-01 00:00:00").cast("timestamp_ntz"))
    return claims(spark, d).select("id", F.floor(age / 86400000000).cast("long").alias("days"), (age > 86400000000 * 365).alias("stale"))


@query("SELECT taxon, nullif(regexp_extract(genus || ' - ' || name, '^([A-Z][A-Za-z]+)\\s*-\\s*(.+)$', 1), '') AS code, nullif(regexp_extract(genus || ' - ' || name, '^([A-Z][A-Za-z]+)\\s*-\\s*(.+)$', 2), '') AS label FROM species")
def fn_koeppen(spark, d):
    k = T.koeppen(F.concat_ws(" - ", "genus", "name"))
    return species(spark, d).select("taxon", k["code"].alias("code"), k["name"].alias("label"))


@query(", p AS (SELECT taxon, unnest([CAST(size AS DOUBLE), CAST(price AS DOUBLE), CASE WHEN size % 5 = 0 THEN NULL ELSE 7.5 END]) AS x FROM species) SELECT taxon, min(x) AS low, max(x) AS high FROM p GROUP BY taxon")
def fn_number_range(spark, d):
    text = F.concat_ws("; ", F.col("size").cast("string"), F.concat(F.col("price").cast("string"), F.lit(" m")), F.when(F.col("size") % 5 == 0, "NA").otherwise("7.5"))
    r = T.number_range(text)
    return species(spark, d).select("taxon", r["low"].alias("low"), r["high"].alias("high"))


@query("SELECT doc_id, md5(replace(replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r')) AS h FROM documents")
def fn_turtle_escape(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.turtle_escape(F.col("text"))).alias("h"))


@query("SELECT taxon, coalesce(habit_human, habit_ai) AS habit, nullif(intact, '') AS intact, greatest(size, 10) AS a, least(size, 40) AS b FROM species")
def fn_null_family(spark, d):
    return species(spark, d).select("taxon", F.coalesce("habit_human", "habit_ai").alias("habit"), F.nullif("intact", F.lit("")).alias("intact"), F.greatest("size", F.lit(10)).alias("a"), F.least("size", F.lit(40)).alias("b"))


@query("SELECT id, CAST(floor(value * 10 + 0.5) AS BIGINT) AS js_round, CAST(ceil(value) AS BIGINT) AS up, round(sqrt(value), 6) AS root, round(ln(1 + value), 6) AS log, abs(50 - value) AS away FROM claims")
def fn_math_family(spark, d):
    v = F.col("value")
    return claims(spark, d).select("id", F.floor(v * 10 + 0.5).alias("js_round"), F.ceil(v).alias("up"), F.round(F.sqrt(v), 6).alias("root"), F.round(F.log1p(v), 6).alias("log"), F.abs(50 - v).alias("away"))


@query("SELECT id, strftime(created, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(created AS DATE) AS day FROM claims WHERE created > TIMESTAMP '2024-01-20'")
def fn_date_family(spark, d):
    rows = claims(spark, d).where("created > timestamp_ntz'2024-01-20 00:00:00'")
    return rows.select("id", F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.to_date("created").alias("day"))


@query("SELECT taxon, CASE WHEN intact IN ('', 'NA') THEN 0 ELSE len(string_split(intact, ';')) END AS n FROM species")
def fn_array_length(spark, d):
    return species(spark, d).select("taxon", T.list_length(F.col("intact"), ";").cast("long").alias("n"))


@query("SELECT tile, CAST(sum(n) AS BIGINT) AS total, count(*) AS taxa FROM occ GROUP BY tile")
def fn_map_totals(spark, d):
    total = F.aggregate(F.map_values("species_data"), F.lit(0).cast("long"), lambda s, x: s + x)
    return tile_maps(spark, d).select("tile", total.alias("total"), F.size("species_data").cast("long").alias("taxa"))


@query("SELECT tile, string_agg(CAST(taxon AS VARCHAR) || ':' || n, ',' ORDER BY CAST(taxon AS VARCHAR)) AS entries FROM occ GROUP BY tile")
def fn_array_to_map(spark, d):
    """An array of {taxon_id, count} objects in JSON becomes a map, and text that is no such array an empty one."""
    items = F.to_json(F.collect_list(F.struct(F.col("taxon").cast("string").alias("taxon_id"), F.col("n").alias("count"))))
    rows = occ(spark, d).groupBy("tile").agg(items.alias("j"))
    parsed = F.from_json("j", "array<struct<taxon_id:string,count:long>>")
    m = F.map_from_entries(F.coalesce(parsed, F.array().cast("array<struct<taxon_id:string,count:bigint>>")))
    text = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return rows.select("tile", F.array_join(text, ",").alias("entries"))


@query("SELECT id, coalesce(json_extract_string(claim_value, '$.text'), json_extract_string(claim_value, '$.name'), claim_value) AS t FROM claims")
def fn_json_text(spark, d):
    return claims(spark, d).select("id", T.claim_text(F.col("claim_value")).alias("t"))


@query("SELECT id, CAST(json_extract_string(claim_value, '$.k') AS BIGINT) AS k FROM claims")
def fn_json_block(spark, d):
    block = T.json_block(F.concat(F.lit("answer: "), F.col("claim_value"), F.lit(" end")))
    return claims(spark, d).select("id", F.get_json_object(block, "$.k").cast("long").alias("k"))


@query("SELECT id, sha256(taxon || '::' || claim_type || '::' || claim_value) AS hash FROM claims")
def fn_claim_hash(spark, d):
    return claims(spark, d).select("id", T.claim_hash(F.col("taxon"), F.col("claim_type"), F.col("claim_value")).alias("hash"))


@query("SELECT conv_id, md5(string_agg(turn || '=' || role, '|' ORDER BY turn)) AS checksum FROM conversations GROUP BY conv_id")
def fn_md5_change(spark, d):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat_ws("=", x["turn"].cast("string"), x["role"]))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.md5(F.array_join(lines, "|")).alias("checksum"))


@query("SELECT taxon, '1.' || (size + 1) || '.0' AS minor, '1.' || size || '.' || (taxon % 9 + 1) AS patch FROM species")
def fn_next_version(spark, d):
    v = F.concat_ws(".", F.lit("1"), F.col("size").cast("string"), (F.col("taxon") % 9).cast("string"))
    return species(spark, d).select("taxon", T.next_version(v, 1).alias("minor"), T.next_version(v, 2).alias("patch"))


@query("SELECT taxon, regexp_replace(family || ' ' || name, '[^a-zA-Z0-9]', '_', 'g') AS file, CASE WHEN contains(native, ',') THEN '\"' || native || '\"' ELSE native END AS csv FROM species")
def fn_file_and_csv(spark, d):
    return species(spark, d).select("taxon", T.file_name(F.concat_ws(" ", "family", "name")).alias("file"), T.csv_field(F.col("native")).alias("csv"))





def _sources():
    """n_sources sources a claim, whose credibility, host and type follow from the claim's id."""
    i = lambda k: F.col("id") + k
    kinds = F.array(*[F.lit(k) for k in ("database", "website", "peer-reviewed")])
    hosts = F.array(*[F.lit(h) for h in ("https://www.gbif.org/x", "http://a.example/y", "https://en.wikipedia.org/wiki/z")])
    one = lambda k: F.struct(F.get(hosts, i(k) % 3).alias("url"), F.get(kinds, i(k) % 3).alias("type"), F.when(i(k) % 4 == 0, 0.9).alias("credibility"))
    all_ = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: one(k))
    return F.slice(all_, F.lit(1), F.col("n_sources"))


_SRC_SQL = """, k AS (SELECT unnest([0, 1, 2, 3]) AS k), s AS (SELECT id, claim_type, claim_value, n_sources, confidence, (id + k) % 3 AS h, CASE WHEN (id + k) % 4 = 0 THEN 0.9 END AS c FROM claims, k WHERE k < n_sources),
a AS (SELECT id, count(*) AS n, count(DISTINCT h) AS kinds, avg(coalesce(c, CASE h WHEN 0 THEN 0.95 WHEN 1 THEN 0.55 ELSE 0.72 END)) AS cred, avg(coalesce(c, 0.5)) AS cred_db, avg(coalesce(c, 0.7)) AS cred_simple FROM s GROUP BY id),
f AS (SELECT c.id, coalesce(n, 0) AS n, coalesce(kinds, 0) AS kinds, cred, cred_db, cred_simple FROM claims c LEFT JOIN a ON c.id = a.id),
g AS (SELECT *, CASE WHEN n >= 3 THEN 0.95 WHEN n = 2 THEN 0.85 WHEN n = 1 THEN 0.70 END AS agree FROM f)
"""


@query(_SRC_SQL + "SELECT id, round(0.5 * CASE WHEN n = 0 THEN 0.3 ELSE least(0.98, cred * (1 + least(0.18, (n - 1) * 0.06)) + least(0.10, (kinds - 1) * 0.05)) END + 0.25 * coalesce(agree, 0.5) + 0.25 * 0.65, 2) AS confidence FROM g")
def conf_evidence(spark, d):
    return claims(spark, d).select("id", conf.conf_evidence(F.col("claim_type"), F.col("claim_value"), _sources()).alias("confidence"))


@query(_SRC_SQL + "SELECT id, round(CAST(0.5 * CASE WHEN n = 0 THEN 0.30 ELSE least(0.98, cred_db * (1 + least(0.18, (n - 1) * 0.06)) + least(0.10, (kinds - 1) * 0.02)) END + 0.25 * coalesce(agree, 0.70) + 0.2 AS DECIMAL(12, 8)), 2) AS confidence FROM g")
def conf_database(spark, d):
    return claims(spark, d).select("id", conf.conf_database(_sources()).alias("confidence"))


@query(_SRC_SQL + "SELECT g.id, round(CASE WHEN g.id % 5 = 0 AND c.confidence <> 0 THEN c.confidence WHEN n > 0 THEN least(cred_simple + least(0.03 * n, 0.1), 0.98) ELSE 0.7 END, 6) AS confidence FROM g JOIN claims c ON c.id = g.id")
def conf_sources_simple(spark, d):
    explicit = F.when(F.col("id") % 5 == 0, F.col("confidence"))
    return claims(spark, d).select("id", F.round(conf.conf_sources_simple(explicit, _sources()), 6).alias("confidence"))


@query("SELECT taxon, round(0.4 * least(c / 5.0, 1) + 0.3 * (h * 1.0 / c) + 0.2 * least(greatest((v - 50) / 150, 0), 1) + 0.1 * CASE WHEN f = 0 THEN 0.5 WHEN f <= 3 THEN 0.7 ELSE 1.0 END, 2) AS confidence FROM (SELECT taxon, count(DISTINCT claim_type) AS c, count(DISTINCT CASE WHEN confidence > 0.8 THEN claim_type END) AS h, avg(value) AS v, count(CASE WHEN n_sources = 3 THEN 1 END) AS f FROM claims GROUP BY taxon)")
def conf_research_run(spark, d):
    g = claims(spark, d).groupBy("taxon").agg(
        F.countDistinct("claim_type").alias("c"), F.countDistinct(F.when(F.col("confidence") > 0.8, F.col("claim_type"))).alias("h"),
        F.avg("value").alias("v"), F.count_if(F.col("n_sources") == 3).alias("f"),
    )
    return g.select("taxon", conf.conf_research_run(F.least(F.col("c") / 5.0, F.lit(1.0)), F.col("h") / F.col("c"), F.col("v"), F.col("f")).alias("confidence"))
