"""Composite queries: what the reference's endpoints and jobs answer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from arborlens.functions import geo, vector
from arborlens.operators.ranking import affinities, leaf_scores, quantity_bands
from arborlens.operators.relational import (
    best_per_group, like_any, match_quality, native_status, not_like_all, page, percentile_place, price_in_credits, stratified, tier, top,
)
from arborlens.plans.analogue import centroids, claims, occ, species, table, tiles
from arborlens.plans.filters import _HAV, NATIVE_SQL
from arborlens.plans.registry import query

N = lambda: F.count(F.lit(1))


@query(f"SELECT DISTINCT o.taxon, s.name FROM tiles t JOIN occ o USING (tile) JOIN species s ON o.taxon = s.taxon WHERE {_HAV.format(a='lat', b='12.5', c='lon', d='33.25')} <= 900000")
def q_nearby(spark, d):
    near = tiles(spark, d).where(geo.within(F.col("lat"), F.col("lon"), 12.5, 33.25, 900000)).select("tile")
    return occ(spark, d, near).select("taxon").distinct().join(species(spark, d).select("taxon", "name"), "taxon")


@query("SELECT tile, n, lat, lon, CAST(sum(n) OVER () AS BIGINT) AS total FROM occ JOIN tiles USING (tile) WHERE taxon = 42")
def q_distribution(spark, d):
    rows = occ(spark, d).where("taxon = 42").join(tiles(spark, d).select("tile", "lat", "lon"), "tile")
    return rows.select("tile", "n", "lat", "lon").crossJoin(rows.agg(F.sum("n").alias("total")))


@query(", t AS (SELECT tile, CAST(sum(n) AS BIGINT) AS n FROM occ JOIN tiles USING (tile) WHERE lon BETWEEN -60 AND 60 AND lat BETWEEN -45 AND 45 GROUP BY tile ORDER BY n DESC, tile LIMIT 10000), m AS (SELECT min(n) AS a, max(n) AS b FROM t) SELECT tile, n, round(CAST(n - a AS DOUBLE) / CASE WHEN b = a THEN 1 ELSE b - a END, 6) AS heat FROM t, m")
def q_heatmap(spark, d):
    box = tiles(spark, d).where("lon between -60 and 60 and lat between -45 and 45").select("tile")
    t = top(occ(spark, d, box).groupBy("tile").agg(F.sum("n").alias("n")), 10000, F.col("n").desc(), F.col("tile"))
    m = t.agg(F.min("n").alias("a"), F.max("n").alias("b"))
    return t.crossJoin(m).select("tile", "n", F.round((F.col("n") - F.col("a")) / F.greatest(F.col("b") - F.col("a"), F.lit(1)), 6).alias("heat"))


@query("SELECT taxon, name, n FROM occ LEFT JOIN species USING (taxon) WHERE tile = 96")
def q_tile(spark, d):
    return occ(spark, d).where("tile = 96").join(species(spark, d).select("taxon", "name"), "taxon", "left").select("taxon", "name", "n")


@query("SELECT tile, seen FROM tiles WHERE seen BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31' AND lon BETWEEN 0 AND 90 AND lat BETWEEN 0 AND 45")
def q_tiles_time(spark, d):
    t = tiles(spark, d).where("seen between timestamp_ntz'1997-01-01 00:00:00' and timestamp_ntz'1997-12-31 00:00:00'")
    return t.where("lon between 0 and 90 and lat between 0 and 45").select("tile", "seen")


@query("SELECT count(DISTINCT tile) AS tiles, count(DISTINCT taxon) AS taxa, CAST(sum(n) AS BIGINT) AS n, min(seen) AS first, max(seen) AS last, min(lon) AS x1, max(lon) AS x2 FROM occ JOIN tiles USING (tile)")
def q_stats(spark, d):
    rows = occ(spark, d).join(tiles(spark, d), "tile")
    return rows.agg(F.countDistinct("tile").alias("tiles"), F.countDistinct("taxon").alias("taxa"), F.sum("n").alias("n"), F.min("seen").alias("first"), F.max("seen").alias("last"), F.min("lon").alias("x1"), F.max("lon").alias("x2"))



@query("SELECT taxon, name, CAST(sum(n) AS BIGINT) AS n, count(*) AS tiles FROM occ JOIN tiles USING (tile) LEFT JOIN species USING (taxon) WHERE eco = 6 GROUP BY 1, 2")
def q_ecoregion_species(spark, d):
    g = occ(spark, d, tiles(spark, d).where("eco = 6")).groupBy("taxon").agg(F.sum("n").alias("n"), N().alias("tiles"))
    return g.join(species(spark, d).select("taxon", "name"), "taxon", "left").select("taxon", "name", "n", "tiles")


@query("SELECT eco, tile FROM tiles WHERE lon BETWEEN 30 AND 31 AND lat BETWEEN -90 AND 90 ORDER BY tile LIMIT 1")
def q_ecoregion_at_point(spark, d):
    return top(tiles(spark, d).where("lon between 30 and 31"), 1, F.col("tile")).select("eco", "tile")



@query("SELECT eco, n_name AS name, count(*) AS tiles FROM tiles JOIN nation ON eco = n_nationkey GROUP BY 1, 2")
def q_ecoregion_stats(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("eco"), F.col("n_name").alias("name"))
    return tiles(spark, d).groupBy("eco").agg(N().alias("tiles")).join(n, "eco").select("eco", "name", "tiles")


@query("SELECT n_nationkey AS eco, n_name AS name FROM nation WHERE n_name ILIKE '%_1%' ORDER BY CASE WHEN n_name ILIKE 'nation_1' THEN 0 ELSE 1 END, n_name LIMIT 10")
def q_ecoregion_search(spark, d):
    c = F.col("n_name")
    rows = table(spark, d, "nation").where(c.ilike("%_1%"))
    return top(rows, 10, F.when(c.ilike("nation_1"), 0).otherwise(1), c).select(F.col("n_nationkey").alias("eco"), c.alias("name"))



@query("SELECT taxon, name FROM species WHERE (native LIKE '%PROMO%' OR native LIKE '%Brand#2%') AND (introduced IS NULL OR NOT (introduced LIKE '%Brand#2%' OR introduced LIKE '%red%'))")
def q_native_by_ecoregion(spark, d):
    s = species(spark, d)
    return s.where(like_any(F.col("native"), ["%PROMO%", "%Brand#2%"]) & not_like_all(F.col("introduced"), ["%Brand#2%", "%red%"])).select("taxon", "name")



_LEAF_SQL = """a AS (SELECT eco, weight, taxon, sum(n) * count(*) AS affinity FROM occ JOIN tiles USING (tile) JOIN w USING (eco) GROUP BY 1, 2, 3),
m AS (SELECT taxon, sum(CAST(affinity AS DOUBLE) * weight) / sum(weight) AS a FROM a GROUP BY taxon),
nat AS (SELECT taxon FROM species WHERE native ILIKE '%brand#2%' OR native ILIKE '%promo%'), intro AS (SELECT taxon FROM species WHERE introduced ILIKE '%brand#2%'),
j AS (SELECT taxon, coalesce(m.a, 100.0) * CASE WHEN nat.taxon IS NOT NULL THEN 2 ELSE 1 END AS affinity, nat.taxon IS NOT NULL AS native FROM m FULL JOIN nat USING (taxon) WHERE taxon NOT IN (SELECT taxon FROM intro)),
r AS (SELECT *, row_number() OVER (ORDER BY round(affinity, 9), taxon) - 1 AS i, count(*) OVER () AS c FROM j),
s AS (SELECT taxon, native, floor(CASE WHEN c = 1 THEN 100.0 ELSE i * 100.0 / (c - 1) END * 10 + 0.5) / 10 AS leaf_score FROM r)
SELECT taxon, name, native, leaf_score, CASE WHEN leaf_score >= 90 THEN 'BEST' WHEN leaf_score >= 70 THEN 'GOOD' WHEN leaf_score >= 50 THEN 'ACCEPTABLE' ELSE 'LOW' END AS tier
FROM (SELECT * FROM s WHERE leaf_score >= 20 ORDER BY leaf_score DESC, taxon LIMIT 2500) LEFT JOIN (SELECT taxon, name FROM species) USING (taxon)"""


def _leaf(spark, d, regions):
    """Taxa ranked for weighted regions (eco, weight)."""
    here = tiles(spark, d).select("tile", "eco").join(regions, "eco")
    s = species(spark, d)
    natives = s.where(like_any(F.col("native"), ["%brand#2%", "%promo%"], ignore_case=True)).select("taxon")
    introduced = s.where(like_any(F.col("introduced"), ["%brand#2%"], ignore_case=True)).select("taxon")
    ranked = leaf_scores(occ(spark, d, here), here, natives, introduced, min_score=20.0)
    return ranked.join(s.select("taxon", "name"), "taxon", "left").select("taxon", "name", "native", "leaf_score", tier(F.col("leaf_score")).alias("tier"))


@query(", w AS (SELECT n_nationkey AS eco, (n_nationkey % 4 + 1) / 4.0::DOUBLE AS weight FROM nation WHERE n_regionkey = 1), " + _LEAF_SQL)
def q_leaf(spark, d):
    """The flagship: taxa ranked for a set of weighted regions."""
    k = F.col("n_nationkey")
    return _leaf(spark, d, table(spark, d, "nation").where("n_regionkey = 1").select(k.alias("eco"), ((k % 4 + 1) / 4.0).cast("double").alias("weight")))


@query(", w AS (SELECT n_nationkey AS eco, 1.0::DOUBLE AS weight FROM nation WHERE n_name = 'NATION_7'), " + _LEAF_SQL)
def q_leaf_name(spark, d):
    """The same for a region by its name."""
    return _leaf(spark, d, table(spark, d, "nation").where("n_name = 'NATION_7'").select(F.col("n_nationkey").alias("eco"), F.lit(1.0).alias("weight")))


@query(", w AS (SELECT eco, 1.0::DOUBLE AS weight FROM (SELECT eco FROM tiles WHERE lon BETWEEN 30 AND 31 ORDER BY tile LIMIT 1)), " + _LEAF_SQL)
def q_leaf_point(spark, d):
    """The same for the region at a point."""
    return _leaf(spark, d, q_ecoregion_at_point(spark, d).select("eco", F.lit(1.0).alias("weight")))



@query(", a AS (SELECT taxon, sum(n) * count(*) AS affinity FROM occ JOIN tiles USING (tile) WHERE eco = 3 GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY affinity, taxon) - 1 AS i, count(*) OVER () AS c FROM a), s AS (SELECT taxon, floor(CASE WHEN c = 1 THEN 100.0 ELSE i * 100.0 / (c - 1) END * 10 + 0.5) / 10 AS score FROM r ORDER BY score DESC, taxon LIMIT 2500) SELECT taxon, score, CASE WHEN score >= 90 THEN 'BEST' WHEN score >= 70 THEN 'GOOD' WHEN score >= 50 THEN 'ACCEPTABLE' ELSE 'LOW' END AS tier FROM s")
def q_guide(spark, d):
    here = tiles(spark, d).where("eco = 3").select("tile", "eco", F.lit(1.0).alias("weight"))
    rows = percentile_place(affinities(occ(spark, d, here), here).select("taxon", "affinity"), "affinity", "taxon")
    return top(rows, 2500, F.col("place").desc(), F.col("taxon")).select("taxon", F.col("place").alias("score"), tier(F.col("place")).alias("tier"))


@query("SELECT taxon, name, affinity FROM (SELECT taxon, CAST(sum(n) * count(*) AS BIGINT) AS affinity FROM occ JOIN tiles USING (tile) WHERE eco = 3 GROUP BY taxon ORDER BY affinity DESC, taxon LIMIT 20) LEFT JOIN species USING (taxon)")
def q_guide_top20(spark, d):
    here = tiles(spark, d).where("eco = 3").select("tile", "eco", F.lit(1.0).alias("weight"))
    best = top(affinities(occ(spark, d, here), here), 20, F.col("affinity").desc(), F.col("taxon")).select("taxon", "affinity")
    return best.join(species(spark, d).select("taxon", "name"), "taxon", "left").select("taxon", "name", "affinity")


@query("SELECT taxon, name, family FROM species WHERE name ILIKE '%gear%' OR family ILIKE '%gear%' ORDER BY CASE WHEN name ILIKE 'gear%' THEN 0 WHEN name ILIKE '%gear' THEN 1 ELSE 2 END, taxon LIMIT 30")
def q_species_search(spark, d):
    c = F.col("name")
    rows = species(spark, d).where(c.ilike("%gear%") | F.col("family").ilike("%gear%"))
    return top(rows, 30, F.when(c.ilike("gear%"), 0).when(c.ilike("%gear"), 1).otherwise(2), F.col("taxon")).select("taxon", "name", "family")


@query("SELECT name, taxon FROM (SELECT name, min(taxon) AS taxon FROM species WHERE name ILIKE 'b%' GROUP BY name) ORDER BY length(name), name LIMIT 10")
def q_species_suggest(spark, d):
    g = species(spark, d).where(F.col("name").ilike("b%")).groupBy("name").agg(F.min("taxon").alias("taxon"))
    return top(g, 10, F.char_length("name"), F.col("name"))


@query("SELECT s.taxon, s.name, s.habit_human, (SELECT count(*) FROM claims c WHERE c.taxon = s.taxon) AS claims, (SELECT min(id) FROM claims c WHERE c.taxon = s.taxon AND current) AS image FROM species s WHERE s.taxon < 60")
def q_species_detail(spark, d):
    s = species(spark, d).where("taxon < 60").select("taxon", "name", "habit_human")
    g = claims(spark, d).where("taxon < 60").groupBy("taxon").agg(N().alias("claims"), F.min(F.when(F.col("current"), F.col("id"))).alias("image"))
    return s.join(g, "taxon", "left").select("taxon", "name", "habit_human", F.coalesce("claims", F.lit(0)).alias("claims"), "image")


@query("SELECT id, taxon FROM claims WHERE taxon = 7 ORDER BY current DESC, id LIMIT 20")
def q_species_images(spark, d):
    return top(claims(spark, d).where("taxon = 7"), 20, F.col("current").desc(), F.col("id")).select("id", "taxon")


@query("SELECT a.taxon, a.subspecies FROM species a WHERE a.name = (SELECT name FROM species WHERE taxon = 8) AND a.subspecies <> 'NA'")
def q_species_subspecies(spark, d):
    s = species(spark, d)
    name = s.where("taxon = 8").select("name")
    return s.where("subspecies <> 'NA'").join(name, "name", "left_semi").select("taxon", "subspecies")


@query("SELECT taxon, claim_type, count(*) AS n, round(avg(confidence), 6) AS confidence FROM claims WHERE current GROUP BY 1, 2")
def q_species_insights(spark, d):
    return claims(spark, d).where("current").groupBy("taxon", "claim_type").agg(N().alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("SELECT taxon, count(*) AS n, CASE WHEN count(*) >= 30 THEN 'researched' ELSE 'partial' END AS status FROM claims WHERE taxon IN (1, 2, 3, 5, 8, 13) GROUP BY taxon")
def q_species_bulk_status(spark, d):
    g = claims(spark, d).where(F.col("taxon").isin(1, 2, 3, 5, 8, 13)).groupBy("taxon").agg(N().alias("n"))
    return g.withColumn("status", F.when(F.col("n") >= 30, "researched").otherwise("partial"))


@query("SELECT s.taxon, s.name, count(c.id) AS names, max(c.created) AS updated FROM species s LEFT JOIN claims c ON s.taxon = c.taxon WHERE s.taxon IN (SELECT taxon FROM (SELECT taxon FROM species ORDER BY name, taxon LIMIT 50 OFFSET 50)) GROUP BY 1, 2")
def q_light_list(spark, d):
    s = page(species(spark, d).select("taxon", "name"), 2, 50, F.col("name"), F.col("taxon"))
    g = claims(spark, d).groupBy("taxon").agg(N().alias("names"), F.max("created").alias("updated"))
    return s.join(g, "taxon", "left").select("taxon", "name", F.coalesce("names", F.lit(0)).alias("names"), "updated")


@query("SELECT id, claim_type FROM claims WHERE taxon = 9 ORDER BY current DESC, corroboration ASC NULLS LAST, id LIMIT 25")
def q_names(spark, d):
    return top(claims(spark, d).where("taxon = 9"), 25, F.col("current").desc(), F.col("corroboration").asc_nulls_last(), F.col("id")).select("id", "claim_type")


@query("SELECT eco, CAST(ceil(CASE WHEN n <= 10 THEN 10.0 WHEN n <= 100 THEN 10 + (n - 10) * 0.5 WHEN n <= 1000 THEN 55 + (n - 100) * 0.2 WHEN n <= 10000 THEN 235 + (n - 1000) * 0.05 ELSE 685 + (n - 10000) * 0.02 END) AS BIGINT) AS credits FROM (SELECT eco, count(*) AS n FROM tiles GROUP BY eco)")
def q_credit_estimate(spark, d):
    return tiles(spark, d).groupBy("eco").agg(N().alias("n")).select("eco", price_in_credits(F.col("n")).alias("credits"))


_POOL = """, c AS (SELECT taxon, count(*) AS tiles, CAST(sum(n) AS BIGINT) AS n FROM occ GROUP BY taxon), pool AS (SELECT s.taxon, genus, family, tiles, n, CASE WHEN n BETWEEN 1 AND 500 THEN 'rare' WHEN n BETWEEN 501 AND 900 THEN 'usual' ELSE 'other' END AS band FROM species s JOIN c USING (taxon) WHERE subspecies = 'NA' AND n BETWEEN 100 AND 50000),
a AS (SELECT taxon, 'band' AS step FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY md5('p1' || taxon), taxon) AS k FROM pool) WHERE k <= 20),
b AS (SELECT taxon, 'genus' AS step FROM (SELECT *, row_number() OVER (PARTITION BY genus ORDER BY md5('p2' || taxon), taxon) AS k FROM pool WHERE taxon NOT IN (SELECT taxon FROM a)) WHERE k <= 5),
e AS (SELECT taxon, 'top' AS step FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY tiles DESC, taxon) AS k FROM pool) WHERE k <= 1),
u AS (SELECT *, CASE step WHEN 'band' THEN 1 WHEN 'genus' THEN 2 ELSE 3 END AS o FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM e))
SELECT taxon, step, band FROM (SELECT *, row_number() OVER (PARTITION BY taxon ORDER BY o) AS k FROM u) JOIN pool USING (taxon) WHERE k = 1"""


@query(_POOL)
def q_select_pilot(spark, d):
    """Candidate pool with bands, stratified picks each without those before, the top of each family, one row a taxon."""
    counts = occ(spark, d).groupBy("taxon").agg(N().alias("tiles"), F.sum("n").alias("n"))
    s = species(spark, d).where("subspecies = 'NA'").select("taxon", "genus", "family")
    pool = s.join(counts.where("n between 100 and 50000"), "taxon")
    pool = pool.withColumn("band", quantity_bands(F.col("n"), [(1, 500, "rare"), (501, 900, "usual")])).persist()
    a = stratified(pool, "band", "taxon", 20, "p1")
    b = stratified(pool, "genus", "taxon", 5, "p2", exclude=a)
    e = best_per_group(pool, ["family"], F.col("tiles").desc(), F.col("taxon"))
    steps = [x.select("taxon", F.lit(name).alias("step"), F.lit(o).alias("o")) for o, (name, x) in enumerate((("band", a), ("genus", b), ("top", e)))]
    every = steps[0].unionByName(steps[1]).unionByName(steps[2])
    first = every.groupBy("taxon").agg(F.min_by("step", "o").alias("step"))
    return first.join(pool.select("taxon", "band"), "taxon").select("taxon", "step", "band")


@query("SELECT eco, taxon, n, CAST(sum(n) OVER (PARTITION BY eco) AS BIGINT) AS total FROM (SELECT eco, taxon, CAST(sum(n) AS BIGINT) AS n FROM occ JOIN tiles USING (tile) WHERE eco < 3 GROUP BY 1, 2)")
def q_ecoregion_export(spark, d):
    here = tiles(spark, d).where("eco < 3").select("tile", "eco")
    g = occ(spark, d, here).join(here, "tile").groupBy("eco", "taxon").agg(F.sum("n").alias("n"))
    return g.withColumn("total", F.sum("n").over(Window.partitionBy("eco"))).select("eco", "taxon", "n", "total")


@query(", b AS (SELECT eco, min(lon) AS x1, max(lon) AS x2 FROM tiles GROUP BY eco) SELECT eco, round(x1, 6) AS x1, round(x2 - x1, 6) AS width FROM b")
def src_svg_paths(spark, d):
    """Rings written as SVG path text (M, L, Z) and read back by splitting it, then moved by an affine map."""
    g = tiles(spark, d).groupBy("eco").agg(F.min("lon").alias("x1"), F.max("lon").alias("x2"))
    number = lambda c: ((c + 180) * 2).cast("string")
    path = F.concat(F.lit("M"), number(F.col("x1")), F.lit(",0 L"), number(F.col("x2")), F.lit(",0 L"), number(F.col("x2")), F.lit(",9 Z"))
    points = F.regexp_extract_all(F.col("path"), F.lit(r"[ML]([0-9.E-]+),"), F.lit(1))
    rows = g.select("eco", path.alias("path")).select("eco", F.transform(points, lambda p: p.cast("double") / 2 - 180).alias("xs"))
    return rows.select("eco", F.round(F.array_min("xs"), 6).alias("x1"), F.round(F.array_max("xs") - F.array_min("xs"), 6).alias("width"))


@query(", q AS (SELECT v AS q FROM centroids WHERE cluster = 7), s AS (SELECT taxon, cluster, list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) AS sim FROM centroids, q WHERE taxon = 5) SELECT cluster, round(sim, 6) AS similarity, CASE WHEN sim >= 0.9 THEN 'excellent' WHEN sim >= 0.8 THEN 'good' WHEN sim >= 0.7 THEN 'moderate' WHEN sim >= 0.6 THEN 'marginal' ELSE 'poor' END AS quality FROM s ORDER BY sim DESC, cluster LIMIT 10")
def q_habitat_match(spark, d):
    """How well a place suits one taxon: its clusters by similarity."""
    c = centroids(spark, d)
    rows = vector.similar_to(c.where("taxon = 5"), c.where("cluster = 7").select(F.col("v").alias("q")))
    best = top(rows, 10, F.col("similarity").desc(), F.col("cluster"))
    return best.select("cluster", F.round("similarity", 6).alias("similarity"), match_quality(F.col("similarity")).alias("quality"))


@query(", q AS (SELECT v AS q FROM centroids WHERE cluster = 7), s AS (SELECT taxon, count(*) OVER (PARTITION BY taxon) = 1 AS single, list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) AS sim FROM centroids, q) SELECT taxon, bool_or(single) AS single, round(max(sim), 6) AS similarity FROM s GROUP BY taxon HAVING max(sim) >= 0.1")
def q_from_embedding(spark, d):
    """The best similarity of each taxon to a given vector, and whether one cluster is all there is of it."""
    c = centroids(spark, d)
    rows = vector.similar_to(c, c.where("cluster = 7").select(F.col("v").alias("q"))).groupBy("taxon")
    return rows.agg((N() == 1).alias("single"), F.round(F.max("similarity"), 6).alias("similarity")).where("similarity >= 0.1")


@query("SELECT c_custkey, c_name, count(o_orderkey) AS contributions FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey = 11 GROUP BY 1, 2")
def q_user(spark, d):
    who = table(spark, d, "customer").where("c_custkey = 11").select("c_custkey", "c_name")
    o = table(spark, d, "orders").where("o_custkey = 11").select("o_custkey", "o_orderkey")
    return who.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey", "c_name").agg(F.count("o_orderkey").alias("contributions"))
