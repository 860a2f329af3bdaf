"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlens.functions import geo
from arborlens.operators.ranking import quantity_bands
from arborlens.operators.relational import (
    like_any, match_quality, meaningful, native_status, not_like_all, optional, price_in_credits, tier, top,
)
from arborlens.plans.analogue import centroids, claims, occ, species, table, tile_maps, tiles
from arborlens.plans.registry import query

TAXA = ("1", "7", "42", "100")
#: Country to the regions under which checklists name it; other countries stand for themselves.
REGIONS = {
    "Brazil": ("Brazil North", "Brazil Northeast", "Brazil South", "Brazil Southeast", "Brazil West-Central"),
    "Chile": ("Chile Central", "Chile North", "Chile South"),
    "New Zealand": ("New Zealand North", "New Zealand South"),
    "South Africa": ("Cape Provinces", "Free State", "KwaZulu-Natal", "Northern Provinces"),
}
#: Local languages of some countries.
LANGUAGES = {"NATION_1": ("English", "Fijian", "Hindi"), "NATION_2": ("Arabic", "French"), "NATION_3": ("Kazakh", "Russian"), "NATION_4": ("Russian",)}


@query("SELECT taxon, name, family FROM species WHERE taxon = 42")
def flt_point_lookup(spark, d):
    return species(spark, d).where(F.col("taxon") == 42).select("taxon", "name", "family")


@query("SELECT taxon, name FROM species WHERE taxon IN (1, 7, 42, 100)")
def flt_any_array(spark, d):
    return species(spark, d).where(F.col("taxon").isin([int(t) for t in TAXA])).select("taxon", "name")


@query("SELECT taxon, name FROM species WHERE name ILIKE '%Ring%' OR family ILIKE '%Ring%' OR genus ILIKE '%Ring%' OR habit_ai ILIKE '%Ring%'")
def flt_like_ci(spark, d):
    hit = F.lit(False)
    for c in ("name", "family", "genus", "habit_ai"):
        hit = hit | F.coalesce(F.col(c).ilike("%Ring%"), F.lit(False))
    return species(spark, d).where(hit).select("taxon", "name")


@query("SELECT taxon FROM species WHERE native ILIKE '%economy%' OR native ILIKE '%brand#2%'")
def flt_like_any(spark, d):
    return species(spark, d).where(like_any(F.col("native"), ["%economy%", "%brand#2%"], ignore_case=True)).select("taxon")


@query("SELECT taxon FROM species WHERE native LIKE '%PROMO%' OR native LIKE '%Brand#4%' OR native LIKE '%promo%'")
def flt_like_or_list(spark, d):
    return species(spark, d).where(like_any(F.col("native"), ["%PROMO%", "%Brand#4%", "%promo%"])).select("taxon")


@query("SELECT taxon FROM species WHERE introduced IS NULL OR NOT (introduced LIKE '%red%' OR introduced LIKE '%Brand#1%')")
def flt_not_like_all(spark, d):
    return species(spark, d).where(not_like_all(F.col("introduced"), ["%red%", "%Brand#1%"])).select("taxon")


@query("SELECT cluster, elevation FROM centroids WHERE elevation >= 500")
def flt_optional_param(spark, d):
    return optional(centroids(spark, d), "elevation", low=500, high=None).select("cluster", "elevation")


@query("SELECT tile, seen FROM tiles WHERE seen BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30'")
def flt_range_inclusive(spark, d):
    return tiles(spark, d).where(F.col("seen").between(F.lit("1997-01-01").cast("timestamp"), F.lit("1997-06-30").cast("timestamp"))).select("tile", "seen")


@query("SELECT tile FROM tiles WHERE lon - 0.5 <= 30 AND lon + 0.5 >= 10 AND lat - 0.5 <= 20 AND lat + 0.5 >= -10")
def flt_bbox_intersects(spark, d):
    x, y = F.col("lon"), F.col("lat")
    return tiles(spark, d).where(geo.boxes_meet(x - 0.5, y - 0.5, x + 0.5, y + 0.5, (10, -10, 30, 20))).select("tile")


_HAV = (
    "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"
)


@query(f"SELECT tile, round({_HAV.format(a='lat', b='12.5', c='lon', d='33.25')}, 1) AS metres FROM tiles WHERE {_HAV.format(a='lat', b='12.5', c='lon', d='33.25')} <= 900000")
def flt_dwithin(spark, d):
    y, x = F.col("lat"), F.col("lon")
    rows = tiles(spark, d).where(geo.within(y, x, 12.5, 33.25, 900000))
    return rows.select("tile", F.round(geo.distance(y, x, F.lit(12.5), F.lit(33.25)), 1).alias("metres"))


@query("SELECT tile FROM tiles WHERE lat > -10 AND lat < 20 AND lon > 10 AND lon < 10 + (lat + 10) * 2")
def flt_contains_point(spark, d):
    x, y = F.col("lon"), F.col("lat")
    triangle = geo.ring([(10, -10), (70, 20), (10, 20)])
    return tiles(spark, d).where(geo.boxes_meet(x, y, x, y, (10, -10, 70, 20)) & geo.contains(triangle, x, y)).select("tile")



@query("SELECT tile, n FROM occ WHERE taxon = 42")
def flt_json_haskey(spark, d):
    rows = tile_maps(spark, d).where(F.map_contains_key("species_data", F.lit("42")))
    return rows.select("tile", F.element_at("species_data", F.lit("42")).alias("n"))


@query("SELECT doc_id FROM (SELECT d.doc_id, d.n_chars AS a, l.quality AS b FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE a % 2 IS DISTINCT FROM b")
def flt_is_distinct_from(spark, d):
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("l"), "quality")
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(labels, F.col("doc_id") == F.col("l"), "left")
    return rows.where(~(F.col("n_chars") % 2).eqNullSafe(F.col("quality"))).select("doc_id")


@query("SELECT taxon, intact FROM species WHERE intact <> 'NA' AND trim(intact) <> ''")
def flt_na_sentinel(spark, d):
    return species(spark, d).where(meaningful(F.col("intact")).isNotNull()).select("taxon", "intact")


@query("SELECT taxon FROM species WHERE taxon NOT IN (SELECT taxon FROM occ WHERE n > 60 UNION SELECT taxon FROM species WHERE genus = 'PROMO')")
def flt_not_in_subquery(spark, d):
    s = species(spark, d)
    gone = occ(spark, d).where("n > 60").select("taxon").union(s.where("genus = 'PROMO'").select("taxon")).distinct()
    return s.join(gone, "taxon", "left_anti").select("taxon")


@query("SELECT id, confidence FROM claims WHERE confidence < 0.70 OR corroboration IS NULL OR CAST(json_extract_string(claim_value, '$.k') AS INTEGER) % 2 = 0")
def flt_review_queue(spark, d):
    agree = F.get_json_object("claim_value", "$.k").cast("int") % 2 != 0
    return claims(spark, d).where((F.col("confidence") < 0.70) | F.col("corroboration").isNull() | ~agree).select("id", "confidence")


_UUID = "substr(md5(CAST(id AS {t})), 1, 8) || '-' || CASE WHEN id % 3 = 0 THEN 'xyz' ELSE substr(md5(CAST(id AS {t})), 9, 4) END || '-' || substr(md5(CAST(id AS {t})), 13, 4) || '-' || substr(md5(CAST(id AS {t})), 17, 4) || '-' || substr(md5(CAST(id AS {t})), 21, 12)"


@query(f"SELECT id, {_UUID.format(t='VARCHAR')} AS uuid FROM claims WHERE id % 3 <> 0")
def flt_regex_uuid(spark, d):
    rows = claims(spark, d).select("id", F.expr(_UUID.format(t="STRING")).alias("uuid"))
    return rows.where(F.col("uuid").rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"))


@query("""SELECT taxon, total, CASE WHEN total BETWEEN 100 AND 500 THEN 'low' WHEN total BETWEEN 501 AND 5000 THEN 'medium' WHEN total BETWEEN 5001 AND 50000 THEN 'high' ELSE 'other' END AS band,
  CASE WHEN genus LIKE '%PROMO%' THEN 'tropical' WHEN genus LIKE '%STANDARD%' THEN 'temperate' WHEN genus LIKE '%LARGE%' THEN 'boreal' ELSE 'mixed' END AS biome
FROM (SELECT taxon, CAST(sum(n) AS BIGINT) AS total FROM occ GROUP BY taxon) JOIN species USING (taxon)""")
def prj_case_bucket(spark, d):
    rows = occ(spark, d).groupBy("taxon").agg(F.sum("n").alias("total")).join(species(spark, d).select("taxon", "genus"), "taxon")
    g = F.col("genus")
    biome = F.when(g.like("%PROMO%"), "tropical").when(g.like("%STANDARD%"), "temperate").when(g.like("%LARGE%"), "boreal").otherwise("mixed")
    band = quantity_bands(F.col("total"), [(100, 500, "low"), (501, 5000, "medium"), (5001, 50000, "high")])
    return rows.select("taxon", "total", band.alias("band"), biome.alias("biome"))


@query("SELECT id, CASE WHEN confidence * 100 >= 90 THEN 'BEST' WHEN confidence * 100 >= 70 THEN 'GOOD' WHEN confidence * 100 >= 50 THEN 'ACCEPTABLE' ELSE 'LOW' END AS tier FROM claims")
def prj_tier(spark, d):
    return claims(spark, d).select("id", tier(F.col("confidence") * 100).alias("tier"))


@query("SELECT id, CASE WHEN confidence >= 0.9 THEN 'excellent' WHEN confidence >= 0.8 THEN 'good' WHEN confidence >= 0.7 THEN 'moderate' WHEN confidence >= 0.6 THEN 'marginal' ELSE 'poor' END AS quality FROM claims")
def prj_match_quality(spark, d):
    return claims(spark, d).select("id", match_quality(F.col("confidence")).alias("quality"))


_NATIVE = "coalesce(lower(native) LIKE '%economy%' OR lower(native) LIKE '%brand#1%', false)"
_INTRODUCED = "coalesce(lower(introduced) LIKE '%economy%' OR lower(introduced) LIKE '%brand#1%', false)"
NATIVE_SQL = f"CASE WHEN {_NATIVE} AND {_INTRODUCED} THEN 'native_and_introduced' WHEN {_NATIVE} THEN 'native' WHEN {_INTRODUCED} THEN 'introduced' ELSE 'unknown' END"


@query(f"SELECT taxon, CASE WHEN size = 50 THEN 'invasive' ELSE {NATIVE_SQL} END AS status FROM species")
def prj_native_status(spark, d):
    s = species(spark, d)
    return s.select("taxon", native_status(F.col("native"), F.col("introduced"), ["Economy", "Brand#1"], F.col("size") == 50).alias("status"))


@query("SELECT taxon, CASE WHEN intact LIKE '%YES%' THEN 'present' WHEN intact = 'NO' THEN 'absent' ELSE 'unknown' END AS forest FROM species")
def prj_intact_status(spark, d):
    c = F.col("intact")
    return species(spark, d).select("taxon", F.when(c.like("%YES%"), "present").when(c == "NO", "absent").otherwise("unknown").alias("forest"))


@query(""", asked AS (SELECT taxon FROM species WHERE taxon < 40 UNION SELECT 9000000 + n_nationkey FROM nation),
counts AS (SELECT taxon, count(*) AS n FROM claims GROUP BY taxon)
SELECT taxon, coalesce(n, 0) AS n, CASE WHEN n >= 30 THEN 'researched' WHEN n > 0 THEN 'partial' ELSE 'unresearched' END AS status FROM asked LEFT JOIN counts USING (taxon)""")
def prj_research_status(spark, d):
    known = species(spark, d).where("taxon < 40").select("taxon")
    asked = known.union(table(spark, d, "nation").select((F.col("n_nationkey") + 9000000).cast("long").alias("taxon")))
    counts = claims(spark, d).groupBy("taxon").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    rows = asked.join(counts, "taxon", "left").select("taxon", n.alias("n"))
    return rows.withColumn("status", F.when(F.col("n") >= 30, "researched").when(F.col("n") > 0, "partial").otherwise("unresearched"))


@query("""SELECT taxon, ha, CAST(ceil(CASE WHEN ha <= 10 THEN 10.0 WHEN ha <= 100 THEN 10 + (ha - 10) * 0.5 WHEN ha <= 1000 THEN 55 + (ha - 100) * 0.2
  WHEN ha <= 10000 THEN 235 + (ha - 1000) * 0.05 ELSE 685 + (ha - 10000) * 0.02 END) AS BIGINT) AS credits FROM (SELECT taxon, size * size * 5 AS ha FROM species)""")
def prj_price_tiers(spark, d):
    rows = species(spark, d).select("taxon", (F.col("size") * F.col("size") * 5).alias("ha"))
    return rows.withColumn("credits", price_in_credits(F.col("ha")))


@query("SELECT n_nationkey, CASE n_name WHEN 'NATION_1' THEN 'United States' WHEN 'NATION_2' THEN 'United Kingdom' ELSE n_name END AS country FROM nation")
def prj_country_alias(spark, d):
    c = F.col("n_name")
    alias = F.when(c == "NATION_1", "United States").when(c == "NATION_2", "United Kingdom").otherwise(c)
    return table(spark, d, "nation").select("n_nationkey", alias.alias("country"))


@query(""", langs(country, lang) AS (VALUES ('NATION_1', 'Fijian'), ('NATION_1', 'Hindi'), ('NATION_2', 'Arabic'), ('NATION_2', 'French'), ('NATION_3', 'Kazakh'), ('NATION_3', 'Russian'), ('NATION_4', 'Russian'))
SELECT n_regionkey, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS languages FROM nation JOIN langs ON n_name = country GROUP BY n_regionkey""")
def prj_language_expand(spark, d):
    names = F.create_map(*[x for k, v in LANGUAGES.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])
    rows = table(spark, d, "nation").select("n_regionkey", F.explode(F.try_element_at(names, F.col("n_name"))).alias("lang")).where("lang <> 'English'")
    return rows.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("lang")), ", ").alias("languages"))


@query("SELECT taxon, name FROM species WHERE contains(lower(name), 'gear') OR contains(lower(family), 'gear')")
def flt_contains_ci_mem(spark, d):
    return species(spark, d).where(F.contains(F.lower("name"), F.lit("gear")) | F.contains(F.lower("family"), F.lit("gear"))).select("taxon", "name")


@query("SELECT taxon, habit_ai IS NOT NULL AND habit_ai <> '' AS researched FROM species")
def prj_researched_flag(spark, d):
    s = species(spark, d)
    flag = F.lit(False)
    for c in (c for c in s.columns if c.endswith("_ai")):
        flag = flag | (F.coalesce(F.col(c), F.lit("")) != "")
    return s.select("taxon", flag.alias("researched"))


@query(""", m(country, region) AS (VALUES ('Brazil', 'Brazil North'), ('Brazil', 'Brazil Northeast'), ('Brazil', 'Brazil South'), ('Brazil', 'Brazil Southeast'), ('Brazil', 'Brazil West-Central'),
  ('Chile', 'Chile Central'), ('Chile', 'Chile North'), ('Chile', 'Chile South')),
c AS (SELECT n_nationkey, CASE n_nationkey WHEN 1 THEN 'Brazil' WHEN 2 THEN 'Chile' ELSE n_name END AS country FROM nation)
SELECT n_nationkey, coalesce(region, country) AS region FROM c LEFT JOIN m USING (country)""")
def prj_region_expand(spark, d):
    names = F.create_map(*[x for k, v in REGIONS.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])
    country = F.when(F.col("n_nationkey") == 1, "Brazil").when(F.col("n_nationkey") == 2, "Chile").otherwise(F.col("n_name"))
    return table(spark, d, "nation").select("n_nationkey", F.explode(F.coalesce(F.try_element_at(names, country), F.array(country))).alias("region"))


@query("SELECT taxon, name, price FROM species ORDER BY price DESC, taxon LIMIT 25")
def srt_topk(spark, d):
    return top(species(spark, d), 25, F.col("price").desc(), F.col("taxon")).select("taxon", "name", "price")
