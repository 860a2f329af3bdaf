"""Joins, upserts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborlens.operators import spatial
from arborlens.operators.relational import (
    best_per_group, explode_map, insert_ignore, pick_per_group, update_from, upsert_last_wins, upsert_with,
)
from arborlens.plans.analogue import centroids, claims, occ, species, table, tile_maps, tiles
from arborlens.plans.registry import query


@query("SELECT id, claim_type, c_name FROM claims JOIN customer ON taxon = c_custkey WHERE confidence >= 0.5")
def jn_inner_equi(spark, d):
    who = table(spark, d, "customer").select("c_custkey", "c_name")
    return claims(spark, d).where("confidence >= 0.5").join(who, F.col("taxon") == F.col("c_custkey")).select("id", "claim_type", "c_name")


@query("SELECT cluster, c.taxon, s.name FROM centroids c LEFT JOIN (SELECT * FROM species WHERE size > 10) s ON c.taxon = s.taxon")
def jn_left_equi(spark, d):
    return centroids(spark, d).join(species(spark, d).where("size > 10").select("taxon", "name"), "taxon", "left").select("cluster", "taxon", "name")


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.toxic = 1")
def jn_left_with_residual(spark, d):
    labels = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("l"), "quality")
    return table(spark, d, "documents").select("doc_id").join(labels, F.col("doc_id") == F.col("l"), "left").select("doc_id", "quality")


@query("SELECT tile, round(CAST(n AS DOUBLE) / total, 9) AS share FROM (SELECT tile, CAST(sum(n) AS BIGINT) AS n FROM occ GROUP BY tile), (SELECT sum(n) AS total FROM occ)")
def jn_cross_scalar(spark, d):
    o = occ(spark, d)
    sums = o.groupBy("tile").agg(F.sum("n").alias("n"))
    return sums.crossJoin(o.agg(F.sum("n").alias("total"))).select("tile", F.round(F.col("n") / F.col("total"), 9).alias("share"))


@query("SELECT n_nationkey, first FROM nation LEFT JOIN (SELECT n_name AS first FROM nation WHERE n_name = 'NATION_3') ON true")
def jn_left_on_true(spark, d):
    n = table(spark, d, "nation")
    one = n.where("n_name = 'NATION_3'").select(F.col("n_name").alias("first"))
    return n.select("n_nationkey").join(one, F.lit(True), "left")


_BOXES = "boxes AS (SELECT n_nationkey AS box, CAST(n_nationkey * 37 % 340 AS DOUBLE) - 180 AS x1, CAST(n_nationkey * 23 % 160 AS DOUBLE) - 90 AS y1, CAST(n_nationkey * 37 % 340 AS DOUBLE) - 160 AS x2, CAST(n_nationkey * 23 % 160 AS DOUBLE) - 75 AS y2 FROM nation)"


def _boxes(spark, d):
    k = F.col("n_nationkey")
    x, y = (k * 37 % 340).cast("double") - 180, (k * 23 % 160).cast("double") - 90
    return table(spark, d, "nation").select(k.alias("box"), x.alias("x1"), y.alias("y1"), (x + 20).alias("x2"), (y + 15).alias("y2"))


@query(f", {_BOXES} SELECT a.box AS a, b.box AS b FROM boxes a JOIN boxes b ON a.box < b.box AND a.x1 <= b.x2 AND a.x2 >= b.x1 AND a.y1 <= b.y2 AND a.y2 >= b.y1")
def jn_spatial_intersects(spark, d):
    return spatial.boxes_that_meet(_boxes(spark, d), "box", cell=20.0).where("a < b").select("a", "b")


@query(f", {_BOXES} SELECT tile, min(box) AS box FROM tiles JOIN boxes ON lon >= x1 AND lon <= x2 AND lat >= y1 AND lat <= y2 GROUP BY tile")
def jn_spatial_contains(spark, d):
    found = spatial.points_in_boxes(tiles(spark, d).select("tile", "lon", "lat"), _boxes(spark, d), "lon", "lat", cell=10.0)
    return found.groupBy("tile").agg(F.min("box").alias("box"))


_OVERLAP = "(least(lon + 3, x2) - greatest(lon - 3, x1)) * (least(lat + 3, y2) - greatest(lat - 3, y1))"


@query(f""", {_BOXES}, m AS (SELECT tile, box, {_OVERLAP} AS area FROM tiles JOIN boxes ON lon - 3 <= x2 AND lon + 3 >= x1 AND lat - 3 <= y2 AND lat + 3 >= y1)
SELECT tile, box, round(area, 6) AS area FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY area DESC, box) AS k FROM m) WHERE k = 1""")
def jn_spatial_maxoverlap(spark, d):
    t = tiles(spark, d).select("tile", (F.col("lon") - 3).alias("x1"), (F.col("lat") - 3).alias("y1"), (F.col("lon") + 3).alias("x2"), (F.col("lat") + 3).alias("y2"))
    return spatial.largest_overlap(t, _boxes(spark, d), "tile", "box", cell=10.0).select("tile", "box", F.round("area", 6).alias("area"))


@query("SELECT c_custkey, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS last FROM customer")
def jn_lateral_max(spark, d):
    last = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    return table(spark, d, "customer").select("c_custkey").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "last")


@query("SELECT c_custkey, o_orderkey FROM (SELECT o_custkey AS c_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def jn_lateral_topk(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return best_per_group(o, ["c_custkey"], F.col("o_totalprice").desc(), F.col("o_orderkey")).select("c_custkey", "o_orderkey")


@query("SELECT tile, CAST(taxon AS VARCHAR) AS taxon, n FROM occ")
def jn_lateral_srf(spark, d):
    return explode_map(tile_maps(spark, d), "species_data")


@query("SELECT s.taxon, count(*) AS tiles FROM species s JOIN occ o ON s.taxon = o.taxon WHERE s.genus = 'PROMO' GROUP BY s.taxon")
def jn_json_key_theta(spark, d):
    keys = explode_map(tile_maps(spark, d), "species_data").select(F.col("taxon").cast("long").alias("taxon"))
    return species(spark, d).where("genus = 'PROMO'").select("taxon").join(keys, "taxon").groupBy("taxon").agg(F.count(F.lit(1)).alias("tiles"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT taxon FROM claims WHERE current)")
def jn_semi_distinct(spark, d):
    c = claims(spark, d).where("current").select("taxon")
    return table(spark, d, "customer").select("c_custkey").join(c, F.col("c_custkey") == F.col("taxon"), "left_semi")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jn_anti_null(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT id FROM claims EXCEPT SELECT id FROM claims WHERE n_sources >= 2")
def jn_anti_setdiff(spark, d):
    c = claims(spark, d)
    return c.select("id").join(c.where("n_sources >= 2").select("id"), "id", "left_anti")


@query(""", e AS (SELECT DISTINCT eco, taxon FROM occ JOIN tiles USING (tile))
SELECT a.eco AS a, b.eco AS b, count(DISTINCT a.taxon) AS shared FROM e a JOIN e b ON a.taxon = b.taxon AND a.eco < b.eco WHERE a.eco <= 4 AND b.eco <= 4 GROUP BY 1, 2""")
def jn_self_shared(spark, d):
    e = occ(spark, d).join(tiles(spark, d).where("eco <= 4").select("tile", "eco"), "tile").select("eco", "taxon").distinct()
    a, b = e.withColumnRenamed("eco", "a"), e.withColumnRenamed("eco", "b")
    return a.join(b, "taxon").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


@query("SELECT taxon, name, CAST(sum(n) AS BIGINT) AS n FROM occ LEFT JOIN species USING (taxon) GROUP BY taxon, name")
def jn_hash_lookup(spark, d):
    sums = occ(spark, d).groupBy("taxon").agg(F.sum("n").alias("n"))
    return sums.join(species(spark, d).select("taxon", "name"), "taxon", "left").select("taxon", "name", "n")


@query(""", m AS (SELECT taxon AS old, taxon // 10 AS new FROM species WHERE taxon % 2 = 0)
SELECT tile, coalesce(new, taxon) AS taxon, CAST(sum(n) AS BIGINT) AS n FROM occ LEFT JOIN m ON taxon = old GROUP BY 1, 2""")
def jn_id_remap(spark, d):
    """Entries that meet under one new id are added up (the reference lets the last one win, in no stated order)."""
    ids = species(spark, d).where("taxon % 2 = 0").select(F.col("taxon").alias("old"), F.floor(F.col("taxon") / 10).alias("new"))
    rows = explode_map(tile_maps(spark, d), "species_data").withColumn("taxon", F.col("taxon").cast("long"))
    rows = rows.join(ids, F.col("taxon") == F.col("old"), "left").select("tile", F.coalesce("new", "taxon").alias("taxon"), "n")
    return rows.groupBy("tile", "taxon").agg(F.sum("n").alias("n"))


@query(""", last AS (SELECT l_orderkey, max_by(l_shipmode, l_linenumber) AS x FROM (SELECT l_orderkey, l_linenumber, l_returnflag AS l_shipmode FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) AS k FROM lineitem) WHERE k = 1) GROUP BY 1)
SELECT o_orderkey, x AS flag, c_name FROM orders LEFT JOIN last ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'""")
def jn_dwca_star(spark, d):
    """A core table with two extensions, each reduced to its last row for a key before the join."""
    lines = pick_per_group(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], F.col("l_partkey"), "l_returnflag")
    ext = pick_per_group(lines, ["l_orderkey"], -F.col("l_linenumber"), "l_returnflag")
    core = table(spark, d, "orders").where("o_orderstatus = 'F'")
    rows = core.join(ext, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    who = table(spark, d, "customer").select("c_custkey", "c_name")
    return rows.join(who, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.col("l_returnflag").alias("flag"), "c_name")


@query("SELECT a.taxon AS old, b.taxon AS new FROM species a JOIN species b ON a.name = b.name WHERE a.size = 7 AND b.size = 9")
def jn_name_fanout(spark, d):
    s = species(spark, d)
    a, b = s.where("size = 7").select(F.col("taxon").alias("old"), "name"), s.where("size = 9").select(F.col("taxon").alias("new"), "name")
    return a.join(b, "name").select("old", "new")


@query(f""", {_BOXES}, m AS (SELECT tile, box, sqrt(pow(lon - x1, 2) + pow(lat - y1, 2)) AS dist FROM tiles, boxes),
k AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY dist, box) AS k FROM m)
SELECT tile, box, round(dist, 6) AS dist, CASE WHEN dist < 10 THEN 'high' WHEN dist < 30 THEN 'medium' ELSE 'low' END AS trust FROM k WHERE k = 1""")
def jn_nearest(spark, d):
    """The nearest reference point, by growing rings of cells."""
    near = spatial.nearest(tiles(spark, d).select("tile", "lon", "lat"), _boxes(spark, d).select("box", "x1", "y1"), ["tile"], "box")
    dist = F.col("dist")
    trust = F.when(dist < 10, "high").when(dist < 30, "medium").otherwise("low")
    return near.select("tile", "box", F.round(dist, 6).alias("dist"), trust.alias("trust"))


@query(""", e AS (SELECT DISTINCT taxon, claim_type FROM claims WHERE id % 3 = 0), a AS (SELECT DISTINCT taxon, claim_type FROM claims WHERE id % 5 <> 0)
SELECT taxon, round(CAST(count(a.claim_type) AS DOUBLE) / count(*), 6) AS share FROM e LEFT JOIN a USING (taxon, claim_type) GROUP BY taxon""")
def jn_country_overlap(spark, d):
    c = claims(spark, d)
    sets = c.groupBy("taxon").agg(F.collect_set(F.when(F.col("id") % 3 == 0, F.col("claim_type"))).alias("expected"), F.collect_set(F.when(F.col("id") % 5 != 0, F.col("claim_type"))).alias("actual"))
    share = F.size(F.array_intersect("actual", "expected")) / F.size("expected")
    return sets.where(F.size("expected") > 0).select("taxon", F.round(share, 6).alias("share"))


@query(f", {_BOXES} SELECT a.box, count(*) AS neighbours FROM boxes a JOIN boxes b ON a.box <> b.box AND a.x1 <= b.x2 AND a.x2 >= b.x1 AND a.y1 <= b.y2 AND a.y2 >= b.y1 GROUP BY a.box")
def jn_topology(spark, d):
    meet = spatial.boxes_that_meet(_boxes(spark, d), "box", cell=20.0).where("a <> b")
    return meet.groupBy(F.col("a").alias("box")).agg(F.count(F.lit(1)).alias("neighbours"))


# writes


def _old_new(spark, d):
    c = claims(spark, d).groupBy("taxon", "claim_type").agg(F.max("confidence").alias("confidence"), F.min("id").alias("id"))
    return c.where("taxon % 3 <> 0"), c.where("taxon % 3 <> 1").withColumn("confidence", F.lit(1.0) - F.col("confidence"))


_OLD_NEW = ", g AS (SELECT taxon, claim_type, max(confidence) AS confidence, min(id) AS id FROM claims GROUP BY 1, 2), o AS (SELECT * FROM g WHERE taxon % 3 <> 0), n AS (SELECT taxon, claim_type, 1.0 - confidence AS confidence, id FROM g WHERE taxon % 3 <> 1)"


@query(_OLD_NEW + " SELECT taxon, claim_type, round(coalesce(n.confidence, o.confidence), 6) AS confidence FROM o FULL JOIN n USING (taxon, claim_type)")
def snk_upsert_lastwins(spark, d):
    old, new = _old_new(spark, d)
    return upsert_last_wins(old, new, ["taxon", "claim_type"]).select("taxon", "claim_type", F.round("confidence", 6).alias("confidence"))


@query(_OLD_NEW + " SELECT taxon, claim_type, round(CASE WHEN o.confidence IS NULL THEN n.confidence WHEN n.confidence IS NULL THEN o.confidence ELSE greatest(o.confidence, n.confidence) END, 6) AS confidence, coalesce(n.id, o.id) AS id FROM o FULL JOIN n USING (taxon, claim_type)")
def snk_upsert_greatest(spark, d):
    old, new = _old_new(spark, d)
    out = upsert_with(old, new, ["taxon", "claim_type"], {"confidence": "greatest", "id": "new"})
    return out.withColumn("confidence", F.round("confidence", 6))


@query(_OLD_NEW + " SELECT taxon, claim_type, round(coalesce(o.confidence, n.confidence), 6) AS confidence FROM o FULL JOIN n USING (taxon, claim_type)")
def snk_upsert_coalesce(spark, d):
    old, new = _old_new(spark, d)
    out = upsert_with(old, new, ["taxon", "claim_type"], {"confidence": "old"})
    return out.withColumn("confidence", F.round("confidence", 6))


@query(", g AS (SELECT taxon, string_agg(claim_type, ',' ORDER BY id) FILTER (WHERE current) AS a, string_agg(claim_type, ',' ORDER BY id) FILTER (WHERE NOT current AND id % 2 = 0) AS b FROM claims GROUP BY taxon) SELECT taxon, concat_ws(',', a, b) AS regions FROM g WHERE a IS NOT NULL OR b IS NOT NULL")
def snk_upsert_array_cat(spark, d):
    c = claims(spark, d)
    lists = lambda rows: rows.groupBy("taxon").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "claim_type"))), lambda x: x["claim_type"]).alias("regions"))
    out = upsert_with(lists(c.where("current")), lists(c.where("not current and id % 2 = 0")), ["taxon"], {"regions": "concat"})
    return out.withColumn("regions", F.array_join("regions", ","))


@query(_OLD_NEW + " SELECT taxon, claim_type, id FROM o UNION ALL SELECT taxon, claim_type, id FROM n WHERE (taxon, claim_type) NOT IN (SELECT (taxon, claim_type) FROM o)")
def snk_insert_ignore(spark, d):
    old, new = _old_new(spark, d)
    return insert_ignore(old, new, ["taxon", "claim_type"]).select("taxon", "claim_type", "id")


@query(_OLD_NEW + " SELECT taxon, claim_type, CASE WHEN n.taxon IS NOT NULL THEN -n.id ELSE o.id END AS id FROM o LEFT JOIN n USING (taxon, claim_type)")
def snk_update_from(spark, d):
    old, new = _old_new(spark, d)
    return update_from(old.select("taxon", "claim_type", "id"), new.withColumn("id", -F.col("id")), ["taxon", "claim_type"], "id")


@query("SELECT id, current AND claim_type <> 'view' AS current FROM claims")
def snk_soft_delete(spark, d):
    return claims(spark, d).select("id", F.when(F.col("claim_type") == "view", False).otherwise(F.col("current")).alias("current"))


# set operations


@query("SELECT 'current' AS part, count(*) AS n FROM claims WHERE current UNION ALL SELECT 'old', count(*) FROM claims WHERE NOT current UNION ALL SELECT 'all', count(*) FROM claims")
def set_union_all(spark, d):
    c = claims(spark, d)
    count = lambda name, rows: rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return count("current", c.where("current")).unionByName(count("old", c.where("not current"))).unionByName(count("all", c))


@query("SELECT taxon FROM species WHERE taxon NOT IN (SELECT taxon FROM species WHERE size < 20 UNION SELECT taxon FROM species WHERE genus = 'LARGE')")
def set_union_distinct(spark, d):
    s = species(spark, d)
    gone = s.where("size < 20").select("taxon").union(s.where("genus = 'LARGE'").select("taxon")).distinct()
    return s.select("taxon").join(gone, "taxon", "left_anti")


@query("SELECT DISTINCT genus, family FROM species")
def set_distinct(spark, d):
    return species(spark, d).select("genus", "family").distinct()


@query("SELECT t.taxon, string_agg(k, ',' ORDER BY k) AS missing FROM (SELECT DISTINCT taxon FROM claims) t, (SELECT DISTINCT claim_type AS k FROM claims) WHERE (t.taxon, k) NOT IN (SELECT (taxon, claim_type) FROM claims WHERE current AND confidence > 0.6) GROUP BY t.taxon")
def set_difference(spark, d):
    c = claims(spark, d)
    kinds = c.agg(F.array_sort(F.collect_set("claim_type")).alias("kinds"))
    covered = c.groupBy("taxon").agg(F.collect_set(F.when(F.col("current") & (F.col("confidence") > 0.6), F.col("claim_type"))).alias("covered"))
    missing = F.array_except("kinds", "covered")
    return covered.crossJoin(kinds).where(F.size(missing) > 0).select("taxon", F.array_join(missing, ",").alias("missing"))


@query("SELECT taxon, count(*) AS n FROM (SELECT DISTINCT taxon, claim_type FROM claims WHERE id % 2 = 0 INTERSECT SELECT DISTINCT taxon, claim_type FROM claims WHERE id % 2 = 1) GROUP BY taxon")
def set_intersection(spark, d):
    sets = claims(spark, d).groupBy("taxon").agg(F.collect_set(F.when(F.col("id") % 2 == 0, F.col("claim_type"))).alias("a"), F.collect_set(F.when(F.col("id") % 2 == 1, F.col("claim_type"))).alias("b"))
    return sets.select("taxon", F.size(F.array_intersect("a", "b")).cast("long").alias("n")).where("n > 0")
