"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlens.operators.relational import explode_map, top
from arborlens.plans.analogue import centroids, claims, occ, species, table, tile_maps, tiles
from arborlens.plans.registry import query



def _ordered(value: str, *order: str, sep: str = "; "):
    """Ordered text aggregate: values sorted by the order columns, nulls left out."""
    items = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("v")))))
    return F.array_join(F.transform(items, lambda x: x["v"]), sep)


@query("SELECT taxon, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT tile) AS tiles FROM occ GROUP BY taxon")
def agg_map_explode_sum(spark, d):
    """Counts and tiles of each taxon. A tile has one map and a map has a key once, so entries count as tiles do."""
    rows = explode_map(tile_maps(spark, d), "species_data").groupBy("taxon").agg(F.sum("n").alias("n"), F.count("tile").alias("tiles"))
    return rows.withColumn("taxon", F.col("taxon").cast("long"))


@query("SELECT taxon, CAST(sum(n) AS BIGINT) AS n, count(*) AS tiles FROM occ JOIN tiles USING (tile) WHERE eco = 3 GROUP BY taxon")
def agg_map_explode_count(spark, d):
    return occ(spark, d).join(tiles(spark, d).where("eco = 3").select("tile"), "tile").groupBy("taxon").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("tiles"))


@query("SELECT taxon, count(*) AS tiles FROM occ GROUP BY taxon")
def agg_key_count(spark, d):
    keys = tile_maps(spark, d).select(F.explode(F.map_keys("species_data")).alias("taxon"))
    return keys.groupBy(F.col("taxon").cast("long").alias("taxon")).agg(F.count(F.lit(1)).alias("tiles"))


@query("SELECT count(DISTINCT tile) AS tiles, count(DISTINCT taxon) AS taxa, CAST(sum(n) AS BIGINT) AS n, min(seen) AS first, max(seen) AS last, count(DISTINCT eco) AS regions FROM occ JOIN tiles USING (tile)")
def agg_global_stats(spark, d):
    rows = occ(spark, d).join(tiles(spark, d), "tile")
    return rows.agg(F.countDistinct("tile").alias("tiles"), F.countDistinct("taxon").alias("taxa"), F.sum("n").alias("n"), F.min("seen").alias("first"), F.max("seen").alias("last"), F.countDistinct("eco").alias("regions"))


@query("SELECT eco, count(DISTINCT tile) AS tiles, count(DISTINCT taxon) AS taxa, CAST(sum(n) AS BIGINT) AS n, round(count(DISTINCT taxon) * 1000.0 / (eco + 1), 3) AS density FROM occ JOIN tiles USING (tile) GROUP BY eco HAVING count(DISTINCT taxon) > 0 ORDER BY taxa DESC, eco LIMIT 50")
def agg_ecoregion_stats(spark, d):
    rows = occ(spark, d).join(tiles(spark, d).select("tile", "eco"), "tile").groupBy("eco")
    rows = rows.agg(F.countDistinct("tile").alias("tiles"), F.countDistinct("taxon").alias("taxa"), F.sum("n").alias("n")).where("taxa > 0")
    return top(rows.withColumn("density", F.round(F.col("taxa") * 1000.0 / (F.col("eco") + 1), 3)), 50, F.col("taxa").desc(), F.col("eco"))


@query("SELECT eco, count(*) AS tiles, min(seen) AS first, max(seen) AS last FROM tiles GROUP BY eco")
def agg_view_ecoregion(spark, d):
    return tiles(spark, d).groupBy("eco").agg(F.count(F.lit(1)).alias("tiles"), F.min("seen").alias("first"), F.max("seen").alias("last"))


@query(", a AS (SELECT n_nationkey AS eco, n_regionkey AS biome, n_nationkey * 10 + 5 AS area FROM nation) SELECT biome, count(*) AS tiles, CAST(sum(area) AS BIGINT) AS joined_area, (SELECT CAST(sum(area) AS BIGINT) FROM a b WHERE b.biome = a.biome) AS area FROM tiles JOIN a USING (eco) GROUP BY biome")
def agg_view_biome(spark, d):
    """Both areas: over joined rows, as the reference's view adds it up, and once a region."""
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("eco"), F.col("n_regionkey").alias("biome"), (F.col("n_nationkey") * 10 + 5).alias("area"))
    joined = tiles(spark, d).join(a, "eco").groupBy("biome").agg(F.count(F.lit(1)).alias("tiles"), F.sum("area").alias("joined_area"))
    return joined.join(a.groupBy("biome").agg(F.sum("area").alias("area")), "biome")


@query("SELECT n_regionkey AS biome, CAST(sum(n) AS BIGINT) AS n FROM occ JOIN tiles USING (tile) JOIN nation ON eco = n_nationkey GROUP BY 1 HAVING sum(n) >= 10 ORDER BY n DESC, biome LIMIT 5")
def agg_having_topk(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("eco"), F.col("n_regionkey").alias("biome"))
    rows = occ(spark, d).join(tiles(spark, d).select("tile", "eco"), "tile").join(n, "eco")
    return top(rows.groupBy("biome").agg(F.sum("n").alias("n")).where("n >= 10"), 5, F.col("n").desc(), F.col("biome"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE current) AS live, count(*) FILTER (WHERE confidence >= 0.8) AS high, count(*) FILTER (WHERE corroboration IS NULL) AS alone FROM claims")
def agg_filter_clause(spark, d):
    c = claims(spark, d)
    return c.agg(F.count(F.lit(1)).alias("total"), F.count_if("current").alias("live"), F.count_if(F.col("confidence") >= 0.8).alias("high"), F.count_if(F.col("corroboration").isNull()).alias("alone"))


@query("SELECT claim_type, count(CASE WHEN current THEN 1 END) AS live, CAST(sum(CASE WHEN n_sources > 1 THEN n_sources ELSE 0 END) AS BIGINT) AS sources FROM claims GROUP BY claim_type")
def agg_case_count(spark, d):
    return claims(spark, d).groupBy("claim_type").agg(F.count(F.when(F.col("current"), 1)).alias("live"), F.sum(F.when(F.col("n_sources") > 1, F.col("n_sources")).otherwise(0)).alias("sources"))


@query("SELECT count(DISTINCT taxon) AS taxa, count(DISTINCT claim_type) AS types, count(DISTINCT corroboration) AS levels FROM claims")
def agg_count_distinct(spark, d):
    return claims(spark, d).agg(F.countDistinct("taxon").alias("taxa"), F.countDistinct("claim_type").alias("types"), F.countDistinct("corroboration").alias("levels"))


@query("SELECT count(DISTINCT CASE WHEN quality IS NOT NULL THEN d.doc_id END) AS matched, count(DISTINCT CASE WHEN quality IS NULL THEN d.doc_id END) AS unmatched FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def agg_distinct_case(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.agg(F.countDistinct(F.when(F.col("quality").isNotNull(), F.col("doc_id"))).alias("matched"), F.countDistinct(F.when(F.col("quality").isNull(), F.col("doc_id"))).alias("unmatched"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def agg_group_status(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT taxon, claim_type, count(*) AS n FROM claims GROUP BY 1, 2 HAVING count(*) > 1")
def agg_group_multi_having(spark, d):
    return claims(spark, d).groupBy("taxon", "claim_type").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT conv_id, string_agg(role || ':' || length(text), '; ' ORDER BY turn DESC) AS line FROM conversations GROUP BY conv_id")
def agg_string_ordered(spark, d):
    rows = table(spark, d, "conversations").withColumn("o", -F.col("turn")).withColumn("line", F.concat("role", F.lit(":"), F.char_length("text").cast("string")))
    return rows.groupBy("conv_id").agg(_ordered("line", "o").alias("line"))


@query("SELECT taxon, claim_type, string_agg(CAST(id AS VARCHAR), '; ' ORDER BY CAST(json_extract_string(claim_value, '$.k') AS INTEGER) ASC NULLS LAST, confidence DESC, id) AS line FROM claims WHERE current GROUP BY 1, 2")
def agg_string_ranked(spark, d):
    rank = F.coalesce(F.get_json_object("claim_value", "$.k").cast("int"), F.lit(2147483647))
    rows = claims(spark, d).where("current").withColumns({"rank": rank, "down": -F.col("confidence"), "line": F.col("id").cast("string")})
    return rows.groupBy("taxon", "claim_type").agg(_ordered("line", "rank", "down", "id").alias("line"))


@query("SELECT taxon, claim_type, arg_max(claim_value, (confidence, -id)) AS claim FROM claims GROUP BY 1, 2")
def agg_top1_json(spark, d):
    return claims(spark, d).groupBy("taxon", "claim_type").agg(F.max_by("claim_value", F.struct("confidence", -F.col("id"))).alias("claim"))


@query(", l AS (SELECT taxon, claim_type, arg_max(id, id) AS id FROM claims WHERE current GROUP BY 1, 2) SELECT taxon, string_agg(claim_type || '=' || id, ',' ORDER BY claim_type) AS object FROM l GROUP BY taxon")
def agg_object(spark, d):
    """A map by claim type, the last claim winning; text for comparison, keys in order."""
    last = claims(spark, d).where("current").groupBy("taxon", "claim_type").agg(F.max("id").alias("id"))
    maps = last.groupBy("taxon").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("claim_type", "id")))).alias("m"))
    text = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return maps.select("taxon", F.array_join(text, ",").alias("object"))


@query("SELECT c_custkey, '[' || coalesce(string_agg('{\"id\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}', ',' ORDER BY o_totalprice DESC, o_orderkey), '') || ']' AS list FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def agg_json_array(spark, d):
    o = table(spark, d, "orders").select("o_custkey", (-F.col("o_totalprice")).alias("p"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    lists = o.groupBy("o_custkey").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("p", "id", "status"))), lambda x: F.struct(x["id"].alias("id"), x["status"].alias("status")))).alias("list"))
    rows = table(spark, d, "customer").select("c_custkey").join(lists, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", F.coalesce("list", F.lit("[]")).alias("list"))


@query("SELECT genus, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT genus, name FROM species WHERE size = 5) GROUP BY genus")
def agg_array_ordered(spark, d):
    return species(spark, d).where("size = 5").groupBy("genus").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"))


@query("SELECT taxon, string_agg(DISTINCT CASE WHEN claim_type = 'view' THEN 'seen' ELSE claim_type END, ',' ORDER BY CASE WHEN claim_type = 'view' THEN 'seen' ELSE claim_type END) AS kinds FROM claims GROUP BY taxon")
def agg_array_distinct(spark, d):
    kind = F.when(F.col("claim_type") == "view", "seen").otherwise(F.col("claim_type"))
    return claims(spark, d).groupBy("taxon").agg(F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"))


@query("SELECT taxon, max(CASE WHEN claim_type = 'view' THEN claim_value END) AS view, max(CASE WHEN claim_type = 'click' THEN claim_value END) AS click, max(CASE WHEN claim_type = 'purchase' THEN claim_value END) AS purchase FROM claims GROUP BY taxon")
def agg_pivot_max_case(spark, d):
    return claims(spark, d).groupBy("taxon").pivot("claim_type", ["view", "click", "purchase"]).agg(F.max("claim_value"))


@query("SELECT CAST(min(n) AS BIGINT) AS low, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS q2, quantile_cont(n, 0.75) AS q3, CAST(max(n) AS BIGINT) AS high FROM (SELECT CAST(sum(n) AS DOUBLE) AS n FROM occ GROUP BY taxon)")
def agg_percentiles(spark, d):
    rows = occ(spark, d).groupBy("taxon").agg(F.sum("n").cast("double").alias("n"))
    q = F.percentile("n", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    rows = rows.agg(F.min("n").cast("long").alias("low"), q.alias("q"), F.max("n").cast("long").alias("high"))
    return rows.select("low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"), "high")


@query("SELECT genus, round(avg(CAST(size AS DOUBLE)), 2) AS size FROM species GROUP BY genus")
def agg_avg_round(spark, d):
    return species(spark, d).groupBy("genus").agg(F.round(F.avg("size"), 2).alias("size"))



@query(", a AS (SELECT eco, CAST(count(*) AS DOUBLE) AS area FROM tiles WHERE lon BETWEEN 0 AND 60 AND lat BETWEEN 0 AND 60 GROUP BY eco) SELECT eco, round(area / (SELECT sum(area) FROM a), 9) AS weight FROM a")
def agg_area_weights(spark, d):
    a = tiles(spark, d).where("lon between 0 and 60 and lat between 0 and 60").groupBy("eco").agg(F.count(F.lit(1)).cast("double").alias("area"))
    return a.crossJoin(a.agg(F.sum("area").alias("total"))).select("eco", F.round(F.col("area") / F.col("total"), 9).alias("weight"))


@query(", s AS (SELECT taxon, n, CAST(n AS DOUBLE) / 200 AS sim FROM occ), t AS (SELECT count(DISTINCT tile) AS samples FROM occ) SELECT taxon, round(CAST(sum(n) AS DOUBLE) / (200 * count(*)), 6) AS mean, round(min(sim), 6) AS low, round(max(sim), 6) AS high, round(max(sim) - min(sim), 6) AS span, round(CAST(count(*) AS DOUBLE) / max(samples), 6) AS coverage, round(0.6 * (CAST(sum(n) AS DOUBLE) / (200 * count(*))) + 0.4 * (CAST(count(*) AS DOUBLE) / max(samples)), 6) AS score FROM s, t GROUP BY taxon")
def agg_multi_sample(spark, d):
    s = occ(spark, d).select("taxon", "tile", "n", (F.col("n") / 200).alias("sim"))
    g = s.crossJoin(s.agg(F.countDistinct("tile").alias("samples"))).groupBy("taxon")
    cover = F.count(F.lit(1)) / F.max("samples")
    mean = F.sum("n") / (200 * F.count(F.lit(1)))  # of whole numbers, so that the order of the sum does not matter
    r = lambda c, n: F.round(c, 6).alias(n)
    return g.agg(r(mean, "mean"), r(F.min("sim"), "low"), r(F.max("sim"), "high"), r(F.max("sim") - F.min("sim"), "span"), r(cover, "coverage"), r(0.6 * mean + 0.4 * cover, "score"))


@query("SELECT count(*) FILTER (WHERE native IS NOT NULL AND introduced IS NULL) AS native, count(*) FILTER (WHERE introduced IS NOT NULL AND native IS NULL) AS introduced, count(*) FILTER (WHERE native IS NOT NULL AND introduced IS NOT NULL) AS both, count(*) FILTER (WHERE native IS NULL AND introduced IS NULL) AS unknown FROM species")
def agg_status_summary(spark, d):
    n, i = F.col("native").isNotNull(), F.col("introduced").isNotNull()
    return species(spark, d).agg(F.count_if(n & ~i).alias("native"), F.count_if(i & ~n).alias("introduced"), F.count_if(n & i).alias("both"), F.count_if(~n & ~i).alias("unknown"))


@query(", t AS (SELECT tile, CAST(sum(n) AS BIGINT) AS n FROM occ GROUP BY tile ORDER BY n DESC, tile LIMIT 1000), m AS (SELECT min(n) AS a, max(n) AS b FROM t) SELECT tile, n, round(CASE WHEN b = a THEN 0.0 ELSE CAST(n - a AS DOUBLE) / (b - a) END, 6) AS heat FROM t, m")
def agg_minmax_normalise(spark, d):
    """Normalised over the rows that the limit leaves; a range of zero divides by one."""
    t = top(occ(spark, d).groupBy("tile").agg(F.sum("n").alias("n")), 1000, F.col("n").desc(), F.col("tile"))
    m = t.agg(F.min("n").alias("a"), F.max("n").alias("b"))
    span = F.when(F.col("b") == F.col("a"), 1).otherwise(F.col("b") - F.col("a"))
    return t.crossJoin(m).select("tile", "n", F.round((F.col("n") - F.col("a")) / span, 6).alias("heat"))


@query("SELECT lower(name) AS name, arg_max(family, taxon) AS family, string_agg(DISTINCT genus, '; ' ORDER BY genus) AS genera, count(DISTINCT genus) AS n FROM species GROUP BY 1")
def agg_griis_species(spark, d):
    g = species(spark, d).groupBy(F.lower("name").alias("name"))
    return g.agg(F.max_by("family", "taxon").alias("family"), F.array_join(F.array_sort(F.collect_set("genus")), "; ").alias("genera"), F.countDistinct("genus").alias("n"))


@query("SELECT family, count(*) AS n, min(size) AS low, max(size) AS high, round(avg(size), 4) AS mean, median(CAST(size AS DOUBLE)) AS median FROM species GROUP BY family ORDER BY n DESC, family LIMIT 5")
def agg_vocab_stats(spark, d):
    g = species(spark, d).groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("low"), F.max("size").alias("high"), F.round(F.avg("size"), 4).alias("mean"), F.median("size").alias("median"))
    return top(g, 5, F.col("n").desc(), F.col("family"))


@query(", s AS (SELECT l_orderkey AS id, sum(CASE l_returnflag WHEN 'A' THEN 95 WHEN 'R' THEN 60 ELSE 80 END) AS total, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey AS id, round(CASE WHEN n IS NULL THEN 0.7::DOUBLE ELSE least(CAST(total AS DOUBLE) / (100 * n) + least(0.03::DOUBLE * n, 0.1::DOUBLE), 0.98::DOUBLE) END, 6) AS confidence FROM orders LEFT JOIN s ON o_orderkey = id")
def agg_avg_sources(spark, d):
    """A claim is an order and its sources are the lines, whose credibility, in hundredths, follows the return flag."""
    flag, n = F.col("l_returnflag"), F.col("n")
    credibility = F.when(flag == "A", 95).when(flag == "R", 60).otherwise(80)
    sources = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum(credibility).alias("total"), F.count(F.lit(1)).alias("n"))
    value = F.least(F.col("total") / (100 * n) + F.least(0.03 * n, F.lit(0.1)), F.lit(0.98))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return orders.join(sources, "id", "left").select("id", F.round(F.when(n.isNull(), 0.7).otherwise(value), 6).alias("confidence"))


@query("SELECT o_custkey AS owner, o_orderkey, CAST(sum(CASE WHEN o_orderkey % 3 = 0 THEN -25 ELSE 100 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS balance FROM orders")
def agg_ledger_balance(spark, d):
    from pyspark.sql import Window

    amount = F.when(F.col("o_orderkey") % 3 == 0, -25).otherwise(100)
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), "o_orderkey", F.sum(amount).over(w).alias("balance"))


@query("SELECT o_custkey AS owner, count(*) AS contributions, CAST(sum(CAST(o_orderkey % 10 AS BIGINT)) AS BIGINT) AS points, max(o_orderdate) AS last FROM orders GROUP BY 1")
def agg_points(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("owner")).agg(F.count(F.lit(1)).alias("contributions"), F.sum(F.col("o_orderkey") % 10).alias("points"), F.max("o_orderdate").alias("last"))


@query("SELECT l_orderkey AS sponsorship, count(*) AS items, count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS done, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS taxa FROM lineitem GROUP BY 1")
def agg_sponsorship_summary(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sponsorship"))
    return g.agg(F.count(F.lit(1)).alias("items"), F.count(F.when(F.col("l_linestatus") == "F", 1)).alias("done"), F.array_join(F.transform(F.sort_array(F.collect_list("l_partkey")), lambda x: x.cast("string")), ",").alias("taxa"))


@query("SELECT taxon, count(*) AS claims, count(DISTINCT claim_type) AS types, round(avg(confidence), 6) AS confidence, count(DISTINCT coalesce(CASE WHEN n_sources > 0 THEN 'http://x/' || (id % 17) END, 'title ' || n_sources)) AS sources FROM claims GROUP BY taxon")
def agg_group_collect(spark, d):
    url = F.when(F.col("n_sources") > 0, F.concat(F.lit("http://x/"), (F.col("id") % 17).cast("string")))
    source = F.coalesce(url, F.concat(F.lit("title "), F.col("n_sources").cast("string")))
    return claims(spark, d).groupBy("taxon").agg(F.count(F.lit(1)).alias("claims"), F.countDistinct("claim_type").alias("types"), F.round(F.avg("confidence"), 6).alias("confidence"), F.countDistinct(source).alias("sources"))


@query("SELECT taxon, claim_type, id FROM (SELECT *, row_number() OVER (PARTITION BY taxon, claim_type ORDER BY confidence DESC, id) AS k FROM claims) WHERE k = 1")
def agg_argmax_mem(spark, d):
    return claims(spark, d).groupBy("taxon", "claim_type").agg(F.min_by("id", F.struct(-F.col("confidence"), F.col("id"))).alias("id"))


@query("SELECT count(*) FILTER (WHERE native LIKE '%;%') AS compound, count(*) FILTER (WHERE native NOT LIKE '%;%') AS simple FROM species")
def agg_id_shape_counts(spark, d):
    c = F.col("native").like("%;%")
    return species(spark, d).agg(F.count_if(c).alias("compound"), F.count_if(~c).alias("simple"))


@query("SELECT claim_type AS strategy, round(avg(value), 1) AS completion, round(avg(n_sources), 1) AS citations, count(*) AS runs FROM claims GROUP BY 1")
def agg_research_ab(spark, d):
    return claims(spark, d).groupBy(F.col("claim_type").alias("strategy")).agg(F.round(F.avg("value"), 1).alias("completion"), F.round(F.avg("n_sources"), 1).alias("citations"), F.count(F.lit(1)).alias("runs"))


@query("SELECT l_partkey AS taxon, l_returnflag AS species, count(*) AS n FROM lineitem GROUP BY 1, 2")
def agg_count_sorted(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("taxon"), F.col("l_returnflag").alias("species")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "taxon", "species")


@query("SELECT CAST(created AS DATE) AS day, count(*) AS n FROM claims GROUP BY 1 ORDER BY day DESC LIMIT 7")
def agg_by_day(spark, d):
    return top(claims(spark, d).groupBy(F.to_date("created").alias("day")).agg(F.count(F.lit(1)).alias("n")), 7, F.col("day").desc())


@query("SELECT round(avg(n), 6) AS mean, max(n) AS most FROM (SELECT floor(lat) AS a, floor(lon) AS b, count(DISTINCT tile) AS n FROM tiles GROUP BY 1, 2)")
def agg_two_level_cells(spark, d):
    cells = tiles(spark, d).groupBy(F.floor("lat"), F.floor("lon")).agg(F.countDistinct("tile").alias("n"))
    return cells.agg(F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def agg_dup_check(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT taxon, CAST(sum(CAST(json_extract_string(claim_value, '$.k') AS BIGINT)) AS BIGINT) AS tokens, round(CAST(sum(CAST(json_extract_string(claim_value, '$.k') AS BIGINT)) AS DOUBLE) / 500, 4) AS cost FROM claims GROUP BY taxon")
def agg_token_summary(spark, d):
    k = F.sum(F.get_json_object("claim_value", "$.k").cast("long"))
    return claims(spark, d).groupBy("taxon").agg(k.alias("tokens"), F.round(k / 500, 4).alias("cost"))


@query("SELECT taxon, count(*) AS clusters, CAST(sum(occurrences) AS BIGINT) AS occurrences, min(year) AS first, max(year) AS last FROM centroids GROUP BY taxon")
def agg_centroid_stats(spark, d):
    return centroids(spark, d).groupBy("taxon").agg(F.count(F.lit(1)).alias("clusters"), F.sum("occurrences").alias("occurrences"), F.min("year").alias("first"), F.max("year").alias("last"))
