"""Stored functions, triggers and views over claims, and the research queue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from arborlens.operators import chains
from arborlens.operators import claims as C
from arborlens.operators.relational import page, top
from arborlens.plans.analogue import claims, species, table
from arborlens.plans.registry import query

KINDS = ("click", "error", "purchase", "signup", "view")
N = lambda: F.count(F.lit(1))
#: A confidence as a decimal, so that a mean does not follow the order in which doubles are added.
_EXACT = "TRY_CAST(confidence AS DECIMAL(18, 12))"


@query("SELECT taxon, claim_type, string_agg('• ' || claim_value, chr(10) ORDER BY confidence DESC, id) AS text FROM claims WHERE current GROUP BY 1, 2")
def udf_aggregate_text(spark, d):
    return C.aggregate_text(claims(spark, d).where("current"), ["taxon", "claim_type"], "claim_value", "\n", "• ")


@query("SELECT taxon, string_agg(claim_type, '; ' ORDER BY corroboration ASC NULLS LAST, confidence DESC, id) AS text FROM claims GROUP BY taxon")
def udf_aggregate_ranked(spark, d):
    return C.aggregate_ranked(claims(spark, d), ["taxon"], "claim_type", "corroboration")


@query("SELECT taxon, claim_type, id, claim_value FROM (SELECT *, row_number() OVER (PARTITION BY taxon, claim_type ORDER BY confidence DESC, id) AS k FROM claims) WHERE k = 1")
def udf_aggregate_top(spark, d):
    return C.top_claim(claims(spark, d), ["taxon", "claim_type"], "id", "claim_value")


@query("SELECT taxon, arg_min(claim_value, (corroboration, -confidence, id)) AS name FROM claims WHERE corroboration IS NOT NULL GROUP BY taxon")
def udf_primary_name(spark, d):
    best = F.min_by("claim_value", F.struct("corroboration", -F.col("confidence"), F.col("id")))
    return claims(spark, d).where("corroboration is not null").groupBy("taxon").agg(best.alias("name"))


def _typed_sql() -> str:
    """Claims of all types as JSON, and a column for each rule."""
    kinds = ", ".join(f"'{r[0]}'" for r in C.SYNC_RULES)
    cols = []
    for name, how, keys, unit in C.SYNC_RULES:
        mine = f"FILTER (WHERE t = '{name}')"
        if how == "text":
            e = f"'• ' || string_agg(coalesce(json_extract_string(v, '$.text'), v), chr(10) || chr(10) || '• ' ORDER BY confidence DESC NULLS LAST, id) {mine}"
        elif how == "ranked":
            e = f"string_agg(json_extract_string(v, '$.name'), '; ' ORDER BY CAST(json_extract_string(v, '$.rank') AS INTEGER) NULLS LAST, confidence DESC, id) {mine}"
        else:
            parts = [f"json_extract_string(b, '$.{k}')" + (f" || '{unit}'" if n == 0 and unit else "") for n, k in enumerate(keys)]
            e = f"(SELECT coalesce({', '.join(parts)}, NULL) FROM (SELECT arg_min(v, (-confidence, id)) {mine} AS b))"
        cols.append(f"{e} AS {name}_ai")
    return f""", k AS (SELECT taxon, id, confidence, [{kinds}][CAST(id % 36 AS INTEGER) + 1] AS t, CASE id % 4
  WHEN 0 THEN '{{"text":"t' || id || '"}}' WHEN 1 THEN '{{"value":' || id % 90 || ',"type":"k' || id % 7 || '","primary":"p' || id % 3 || '","category":"c' || id % 2 || '"}}'
  WHEN 2 THEN '{{"name":"n' || id % 11 || '","rank":' || id % 5 || '}}' ELSE '{{"name":"m' || id % 13 || '","iucn_status":"LC","text":"u' || id || '"}}' END AS v FROM claims WHERE current)
SELECT taxon, count(*) AS synced, {", ".join(cols)} FROM k GROUP BY taxon"""


@query(_typed_sql())
def udf_sync_species(spark, d):
    """All claim types of each taxon as its fields, and the number of claims; every 36th claim is of no known type."""
    i = F.col("id")
    names = F.array(*[F.lit(r[0]) for r in C.SYNC_RULES])
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    value = F.when(i % 4 == 0, c('{"text":"t', i, '"}')).when(i % 4 == 1, c('{"value":', i % 90, ',"type":"k', i % 7, '","primary":"p', i % 3, '","category":"c', i % 2, '"}'))
    value = value.when(i % 4 == 2, c('{"name":"n', i % 11, '","rank":', i % 5, "}")).otherwise(c('{"name":"m', i % 13, '","iucn_status":"LC","text":"u', i, '"}'))
    rows = claims(spark, d).where("current").select("taxon", "id", "confidence", F.get(names, (i % 36).cast("int")).alias("claim_type"), value.alias("claim_value"))
    return C.sync_to_species(rows)


@query("SELECT id, row_number() OVER w AS version, lead(id) OVER w IS NULL AS is_current, lag(id) OVER w AS supersedes FROM claims WINDOW w AS (PARTITION BY taxon, claim_type ORDER BY created, id)")
def str_versioned_state(spark, d):
    return C.versions(claims(spark, d), ["taxon", "claim_type"]).select("id", F.col("version").cast("long").alias("version"), "is_current", "supersedes")


@query(", o AS (SELECT taxon, 1 AS v, name, family, native FROM species WHERE taxon % 2 = 0), n AS (SELECT taxon, CASE WHEN taxon % 3 = 0 THEN 1 ELSE 2 END AS v, CASE WHEN taxon % 5 = 0 THEN 'new ' || name ELSE name END AS name, family, CASE WHEN taxon % 4 = 0 THEN NULL ELSE native END AS native FROM species), j AS (SELECT n.taxon, n.v, o.name AS a, n.name AS b, o.native AS x, n.native AS y FROM o JOIN n USING (taxon) WHERE n.v > o.v) SELECT taxon, v AS version, 'name' AS field, a AS old_value, b AS new_value FROM j WHERE a IS DISTINCT FROM b UNION ALL SELECT taxon, v, 'native', x, y FROM j WHERE x IS DISTINCT FROM y")
def str_scd_log(spark, d):
    s = species(spark, d).select("taxon", "name", "family", "native")
    old = s.where("taxon % 2 = 0").withColumn("v", F.lit(1))
    name = F.when(F.col("taxon") % 5 == 0, F.concat(F.lit("new "), "name")).otherwise(F.col("name"))
    new = s.withColumns({"v": F.when(F.col("taxon") % 3 == 0, 1).otherwise(2), "name": name, "native": F.when(F.col("taxon") % 4 != 0, F.col("native"))})
    return C.change_log(old, new, "taxon", "v", ["name", "family", "native"])


@query(f", t AS (SELECT DISTINCT taxon FROM claims), f(field) AS (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')), g AS (SELECT taxon, claim_type AS field, sum({_EXACT}) AS s, count({_EXACT}) AS n, max({_EXACT}) - min({_EXACT}) AS r FROM claims GROUP BY 1, 2) SELECT t.taxon, f.field, CASE WHEN s IS NULL THEN 'missing' WHEN r > 0.3 THEN 'disputed' WHEN s >= 0.85 * n THEN 'strong' WHEN s < 0.5 * n THEN 'weak' ELSE 'fair' END AS state FROM t CROSS JOIN f LEFT JOIN g ON t.taxon IS NOT DISTINCT FROM g.taxon AND f.field = g.field")
def q_queue_context(spark, d):
    return C.research_context(claims(spark, d), KINDS)


@query(f"SELECT taxon, claim_type AS field FROM claims GROUP BY 1, 2 HAVING sum({_EXACT}) < 0.6 * count({_EXACT})")
def q_queue_gaps(spark, d):
    """Fields whose mean confidence is below 0.6, exactly."""
    return C.below_mean(claims(spark, d), ["taxon", "claim_type"], 0.6).withColumnRenamed("claim_type", "field")


@query(", r AS (SELECT p_partkey AS id, p_brand AS b, p_type AS t FROM part) SELECT id, b AS claim, CASE WHEN id % 2 = 0 THEN 0.80 ELSE 0.70 END::DOUBLE AS confidence FROM r WHERE id % 3 <> 0 UNION ALL SELECT id, t, CASE WHEN id % 2 = 0 THEN 0.80 ELSE 0.70 END::DOUBLE FROM r WHERE id % 3 <> 0 UNION ALL SELECT id, b, 0.75::DOUBLE FROM r WHERE id % 3 = 0")
def udf_atomic_claims(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_type")
    value = F.when(F.col("id") % 3 != 0, F.to_json(F.array("p_brand", "p_type"))).otherwise(F.col("p_brand"))
    rows = p.select("id", value.alias("value"), F.when(F.col("id") % 2 == 0, "http://x").alias("hint"))
    return C.atomic_claims(rows, "id", "value", "hint")


@query("SELECT count(*) FILTER (WHERE confidence < 0.7 OR corroboration IS NULL) AS review, count(*) FILTER (WHERE current) AS current, round(avg(confidence), 6) AS mean, count(DISTINCT (taxon, claim_type)) AS fields FROM claims")
def q_insight_views(spark, d):
    c = claims(spark, d)
    return c.agg(F.count_if((F.col("confidence") < 0.7) | F.col("corroboration").isNull()).alias("review"), F.count_if("current").alias("current"), F.round(F.avg("confidence"), 6).alias("mean"), F.countDistinct("taxon", "claim_type").alias("fields"))


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, min(o_orderdate) AS oldest FROM orders GROUP BY 1, 2")
def q_queue_status(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(N().alias("n"), F.min("o_orderdate").alias("oldest"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 1")
def q_queue_next(spark, d):
    return top(table(spark, d, "orders").where("o_orderstatus = 'P'"), 1, F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_orderkey")).select("o_orderkey")


@query("SELECT n_nationkey AS id FROM nation WHERE n_nationkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def q_queue_bulk_add(spark, d):
    have = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    new = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return have.unionByName(new.join(have, "id", "left_anti"))


@query("SELECT c_custkey, c_name, CAST(sum(o_orderkey % 10) AS BIGINT) AS points, max(o_orderdate) AS last FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2 ORDER BY points DESC, last, c_custkey LIMIT 25")
def q_leaderboard(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_orderkey") % 10).alias("points"), F.max("o_orderdate").alias("last"))
    g = top(g, 25, F.col("points").desc(), F.col("last"), F.col("o_custkey"))
    who = table(spark, d, "customer").select("c_custkey", "c_name")
    return g.join(who, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name", "points", "last")


@query("SELECT o_orderkey, count(*) AS items, count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS done FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(CASE WHEN l_linestatus = 'F' THEN 1 END) < count(*)")
def q_incomplete_sponsorships(spark, d):
    paid = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(N().alias("items"), F.count_if(F.col("l_linestatus") == "F").alias("done")).where("done < items")
    return items.join(paid, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "items", "done")


@query("SELECT o_custkey, o_orderkey, o_totalprice, count(*) AS items FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3")
def q_sponsorship_user(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return o.join(table(spark, d, "lineitem").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "o_orderkey", "o_totalprice").agg(N().alias("items"))


@query("SELECT l_partkey AS taxon, count(DISTINCT o_custkey) AS sponsors, round(sum(l_extendedprice), 2) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def q_sponsorship_species(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    rows = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.col("l_partkey").alias("taxon")).agg(F.countDistinct("o_custkey").alias("sponsors"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))


@query("SELECT o_orderkey, o_orderstatus AS status, count(*) AS items FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def q_sponsorship_tx(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return o.join(table(spark, d, "lineitem").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey", "status").agg(N().alias("items"))


_AMOUNT = "CASE WHEN o_orderkey % 3 = 0 THEN -25 ELSE 100 END"


@query(f"SELECT o_custkey AS owner, CAST(sum({_AMOUNT}) AS BIGINT) AS balance, CAST(sum(CASE WHEN o_orderkey % 3 <> 0 THEN 100 ELSE 0 END) AS BIGINT) AS purchased, CAST(sum(CASE WHEN o_orderkey % 3 = 0 THEN 25 ELSE 0 END) AS BIGINT) AS spent FROM orders GROUP BY 1")
def q_credit_balance(spark, d):
    a = F.expr(_AMOUNT)
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("owner")).agg(F.sum(a).alias("balance"), F.sum(F.greatest(a, F.lit(0))).alias("purchased"), F.sum(F.greatest(-a, F.lit(0))).alias("spent"))


@query(f"SELECT o_orderkey, {_AMOUNT} AS amount FROM orders WHERE o_custkey = 4 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5 OFFSET 5")
def q_credit_history(spark, d):
    rows = table(spark, d, "orders").where("o_custkey = 4").select("o_orderkey", "o_orderdate", F.expr(_AMOUNT).alias("amount"))
    return page(rows, 2, 5, F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).select("o_orderkey", "amount")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 10")
def q_analyses_list(spark, d):
    return page(table(spark, d, "documents"), 2, 10, F.col("n_chars").desc(), F.col("doc_id")).select("doc_id", "n_chars")


@query("SELECT (SELECT count(*) FROM species) AS species, (SELECT count(*) FROM claims) AS claims, (SELECT count(DISTINCT taxon) FROM claims) AS researched, (SELECT count(CASE WHEN current THEN 1 END) FROM claims) AS current")
def q_progress(spark, d):
    c = claims(spark, d).agg(N().alias("claims"), F.countDistinct("taxon").alias("researched"), F.count_if("current").alias("current"))
    return species(spark, d).agg(N().alias("species")).crossJoin(c)


@query("SELECT count(*) FILTER (WHERE was <> now) AS changed, count(*) FILTER (WHERE now) AS researched FROM (SELECT taxon % 3 = 0 AS was, habit_ai <> '' AS now FROM species)")
def q_flag_repair(spark, d):
    rows = species(spark, d).select((F.col("taxon") % 3 == 0).alias("was"), (F.col("habit_ai") != "").alias("now"))
    return rows.agg(F.count_if(F.col("was") != F.col("now")).alias("changed"), F.count_if("now").alias("researched"))


@query("""SELECT id, version, CASE WHEN gone THEN 'missing' WHEN altered THEN 'altered' WHEN max(CAST(altered OR gone AS INTEGER)) OVER (PARTITION BY taxon ORDER BY created, id) = 1 THEN 'broken' ELSE 'ok' END AS state FROM (
  SELECT id, taxon, created, row_number() OVER (PARTITION BY taxon ORDER BY created, id) AS version, id % 101 = 0 AND id % 103 <> 0 AS altered, id % 103 = 0 AS gone FROM claims)""")
def q_archive_history(spark, d):
    """Versions of each taxon's archive, and whether they still hold: every digest covers the one before, so a record that was
    altered or lost after it was archived shows in all that follow it."""
    rows = claims(spark, d).select("id", "taxon", "created", "claim_type", "claim_value")
    digest = chains.content_digest(F.col("id"), F.col("claim_type"), F.col("claim_value"))
    archived = chains.chained(rows.select("id", "taxon", "created", digest.alias("content")), "taxon", ["created", "id"], "content")
    value = F.when(F.col("id") % 101 == 0, "altered").otherwise(F.col("claim_value"))
    found = rows.where("id % 103 <> 0").select("id", "taxon", "created", chains.content_digest(F.col("id"), F.col("claim_type"), value).alias("content"))
    states = chains.verified(archived, found, "taxon", ["created", "id"], ["id"], "content")
    version = F.row_number().over(Window.partitionBy("taxon").orderBy("created", "id")).cast("long")
    return rows.select("id", version.alias("version")).join(states.select("id", "state"), "id")


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS sheet FROM conversations GROUP BY conv_id HAVING md5(string_agg(role, ',' ORDER BY turn)) <> md5('user,assistant')")
def q_sheet_change(spark, d):
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",")
    return table(spark, d, "conversations").groupBy("conv_id").agg(lines.alias("sheet")).where(F.md5("sheet") != F.md5(F.lit("user,assistant")))


@query("SELECT count(DISTINCT p.page_id) AS pages, count(DISTINCT CASE WHEN s.taxon IS NOT NULL THEN p.page_id END) AS matched FROM pages p LEFT JOIN species s ON p.page_id = s.taxon AND s.size > 20")
def q_image_match_stats(spark, d):
    s = species(spark, d).where("size > 20").select("taxon")
    rows = table(spark, d, "pages").select("page_id").join(s, F.col("page_id") == F.col("taxon"), "left")
    return rows.agg(F.countDistinct("page_id").alias("pages"), F.countDistinct(F.when(F.col("taxon").isNotNull(), F.col("page_id"))).alias("matched"))


@query(", g AS (SELECT taxon, claim_type, max(confidence) AS confidence, count(*) AS n FROM claims WHERE id % 2 = 0 GROUP BY 1, 2), h AS (SELECT taxon, claim_type, max(least(confidence + 0.1, 1.0)) AS confidence FROM claims WHERE id % 2 = 1 GROUP BY 1, 2) SELECT taxon, claim_type, round(CASE WHEN g.confidence IS NULL THEN h.confidence WHEN h.confidence IS NULL THEN g.confidence ELSE greatest(g.confidence, h.confidence) END, 6) AS confidence FROM g FULL JOIN h USING (taxon, claim_type)")
def q_research_run(spark, d):
    """New findings merged into stored ones, the better confidence kept."""
    from arborlens.operators.relational import upsert_with

    c = claims(spark, d)
    old = c.where("id % 2 = 0").groupBy("taxon", "claim_type").agg(F.max("confidence").alias("confidence"))
    new = c.where("id % 2 = 1").groupBy("taxon", "claim_type").agg(F.max(F.least(F.col("confidence") + 0.1, F.lit(1.0))).alias("confidence"))
    return upsert_with(old, new, ["taxon", "claim_type"], {"confidence": "greatest"}).withColumn("confidence", F.round("confidence", 6))
