"""Vector and spatial operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from arborlens.functions import geo, vector
from arborlens.operators import ann, lines
from arborlens.operators.clustering import kmeans_per_group
from arborlens.operators.relational import best_per_group, top
from arborlens.plans.analogue import centroids, species, table, tiles
from arborlens.plans.registry import query

_Q = ", q AS (SELECT v AS q FROM centroids WHERE cluster = 0)"
_DOT = "list_dot_product(v, q)"
_COS = "list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q)))"


def _query(c):
    return c.where("cluster = 0").select(F.col("v").alias("q"))


@query(_Q + f" SELECT taxon, cluster, round({_DOT}, 6) AS similarity FROM centroids, q WHERE taxon <> 3 ORDER BY {_DOT} DESC, cluster LIMIT 20")
def vec_dot64(spark, d):
    c = centroids(spark, d)
    rows = vector.similar_to(c.where("taxon <> 3"), _query(c), by="dot")
    return top(rows, 20, F.col("similarity").desc(), F.col("cluster")).select("taxon", "cluster", F.round("similarity", 6).alias("similarity"))


_OTHERS = "FROM centroids c JOIN species s USING (taxon), t WHERE c.taxon <> t.taxon"


@query(f", t AS (SELECT taxon, v AS q FROM centroids WHERE cluster = 3) SELECT c.taxon, name, family, cluster, occurrences, round({_DOT}, 6) AS similarity {_OTHERS} ORDER BY round({_DOT}, 6) DESC, cluster LIMIT 10")
def q_emb_similar(spark, d):
    """Clusters of other taxa most like one cluster of a taxon, by dot product."""
    c, s = centroids(spark, d), species(spark, d).select("taxon", "name", "family")
    own = c.where("cluster = 3").select(F.col("taxon").alias("own"), F.col("v").alias("q"))
    rows = vector.similar_to(c, own, by="dot").where("taxon <> own").join(s, "taxon")
    rows = rows.select("taxon", "name", "family", "cluster", "occurrences", F.round("similarity", 6).alias("similarity"))
    return top(rows, 10, F.col("similarity").desc(), F.col("cluster"))


@query(_Q + f", s AS (SELECT taxon, max({_DOT}) AS sim, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM centroids, q GROUP BY taxon) SELECT taxon, name, round(sim, 6) AS similarity, occurrences FROM s JOIN species USING (taxon) WHERE sim >= 0 ORDER BY sim DESC, taxon LIMIT 15")
def q_emb_predict(spark, d):
    """Taxa that suit an embedding: the best cluster of each, above a threshold, the best first."""
    c = centroids(spark, d)
    best = vector.similar_to(c, _query(c), by="dot").groupBy("taxon").agg(F.max("similarity").alias("sim"), F.sum("occurrences").alias("occurrences"))
    rows = best.where("sim >= 0").join(species(spark, d).select("taxon", "name"), "taxon")
    return top(rows, 15, F.col("sim").desc(), F.col("taxon")).select("taxon", "name", F.round("sim", 6).alias("similarity"), "occurrences")


@query(_Q + f" SELECT taxon, cluster, round({_COS}, 6) AS similarity FROM centroids, q")
def vec_cosine(spark, d):
    c = centroids(spark, d)
    return vector.similar_to(c, _query(c)).select("taxon", "cluster", F.round("similarity", 6).alias("similarity"))


@query(_Q + f", s AS (SELECT *, {_COS} AS sim FROM centroids, q) SELECT taxon, cluster, round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY taxon ORDER BY sim DESC, cluster) AS k FROM s) WHERE k = 1 AND sim >= 0.1 ORDER BY sim DESC, taxon LIMIT 10")
def vec_knn(spark, d):
    c = centroids(spark, d)
    rows = best_per_group(vector.similar_to(c, _query(c)), ["taxon"], F.col("similarity").desc(), F.col("cluster")).where("similarity >= 0.1")
    return top(rows, 10, F.col("similarity").desc(), F.col("taxon")).select("taxon", "cluster", F.round("similarity", 6).alias("similarity"))



@query(""", a AS (SELECT a.cluster AS a, b.cluster AS b, list_distance(a.v, b.v) AS dist FROM centroids a, centroids b WHERE a.cluster % 50 = 0 AND a.cluster <> b.cluster)
SELECT a, b, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS k FROM a) WHERE k <= 5""")
def vec_ann_index(spark, d):
    """The five nearest of every 50th vector by the index of inverted lists. The given vectors point in unrelated directions,
    so most lists must be compared; on clustered ones few are."""
    rows = centroids(spark, d)
    index, sizes, centres = ann.build(rows.select(F.col("cluster").alias("id"), "v"))
    asked = rows.where("cluster % 50 = 0").select(F.col("cluster").alias("q"), "v")
    found, _ = ann.nearest(index, sizes, centres, asked, 5)
    return found.select(F.col("q").alias("a"), F.col("id").alias("b"), F.round("dist", 6).alias("dist"))


@query()
def vec_cluster(spark, d):
    rows = centroids(spark, d).withColumn("year", F.col("year").cast("double"))
    return kmeans_per_group(rows, "taxon", "v", ("year",)).select("taxon", "cluster", "size", "year", F.round(F.col("centroid")[0], 6).alias("first"))


@query("SELECT cluster, round(v[1] + v[3], 6) AS s FROM centroids WHERE cluster % 10 <> 0")
def vec_object_to_array(spark, d):
    names = ["a00", "a01", "a02"]
    m = F.map_from_arrays(F.array(*[F.lit(n) for n in names[:2]], F.when(F.col("cluster") % 10 == 0, "zzz").otherwise("a02")), F.slice("v", 1, 3))
    a = vector.from_object(m, names)
    return centroids(spark, d).select("cluster", a.alias("a")).where("a is not null").select("cluster", F.round(F.col("a")[0] + F.col("a")[2], 6).alias("s"))


@query(", c AS (SELECT tile, lat, lon, CAST(least(floor((lon + 180) / 360 * 262144), 262143) AS BIGINT) AS x, CAST(least(floor((lat + 90) / 180 * 131072), 131071) AS BIGINT) AS y FROM tiles) SELECT tile, x / 262144.0 * 360 - 180 AS lon_min, y / 131072.0 * 180 - 90 AS lat_min, (x + 1) / 262144.0 * 360 - 180 AS lon_max, (y + 1) / 131072.0 * 180 - 90 AS lat_max FROM c")
def geo_geohash_decode(spark, d):
    """Bounds of the tiles' seven-letter geohashes, decoded from the letters."""
    rows = tiles(spark, d).select("tile", geo.geohash(F.col("lat"), F.col("lon")).alias("code"))
    return rows.select("tile", geo.geohash_bounds(F.col("code")).alias("b")).select("tile", "b.*")



_X2, _Y2 = "least(lon + 1, 180)", "least(lat + 1, 90)"


@query("SELECT tile, round(radians(0.5) * abs(sin(radians(lat + 0.5)) - sin(radians(lat))) * 6371.0088 * 6371.0088, 1) AS km2, CAST(0.25 AS DOUBLE) AS planar FROM tiles WHERE lat < 89")
def geo_area(spark, d):
    x, y = F.col("lon"), F.col("lat")
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    r = F.array(p(x, y), p(x + 0.5, y), p(x + 0.5, y + 0.5), p(x, y + 0.5))
    rows = tiles(spark, d).where("lat < 89").withColumn("r", r)
    return rows.select("tile", F.round(geo.sphere_area(F.col("r")) / 1e6, 1).alias("km2"), F.round(geo.planar_area(F.col("r")), 6).alias("planar"))


@query("SELECT tile, round(greatest(least(lon + 4, 30.0) - greatest(lon, 10.0), 0) * greatest(least(lat + 3, 20.0) - greatest(lat, -10.0), 0), 6) AS shared FROM tiles WHERE lon <= 30 AND lon + 4 >= 10 AND lat <= 20 AND lat + 3 >= -10")
def geo_intersection(spark, d):
    """Common area of tiles' boxes and a box, by clipping rings in Arrow batches."""
    x, y = F.col("lon"), F.col("lat")
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    rows = tiles(spark, d).where(geo.boxes_meet(x, y, x + 4, y + 3, (10.0, -10.0, 30.0, 20.0)))
    rows = rows.select("tile", geo.clip_to_box((10.0, -10.0, 30.0, 20.0))(F.array(p(x, y), p(x + 4, y), p(x + 4, y + 3), p(x, y + 3))).alias("r"))
    return rows.select("tile", F.round(F.when(F.size("r") >= 3, geo.planar_area(F.col("r"))).otherwise(0.0), 6).alias("shared"))


def _tracks(spark, d):
    """Each region's track of tiles, numbered by time and tile."""
    rows = tiles(spark, d).select("eco", "seen", "tile", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return lines.numbered(rows, "eco", F.to_date("seen"), ["seen", "tile"])


_BOUNDS = [F.min, F.min, F.max, F.max]


@query()
def geo_simplify(spark, d):
    """Corners of each region's track of tiles, before and after thinning by pieces, and its envelope."""
    points = _tracks(spark, d)
    kept = lines.thinned(points, "eco", "place", "x", "y", 40.0, 256).groupBy("eco").agg(F.count(F.lit(1)).cast("int").alias("kept"))
    box = [f(c).alias(n) for f, c, n in zip(_BOUNDS, ("x", "y", "x", "y"), ("x1", "y1", "x2", "y2"), strict=True)]
    return points.groupBy("eco").agg(F.count(F.lit(1)).cast("int").alias("corners"), *box).join(kept, "eco").select("eco", "corners", "kept", "x1", "y1", "x2", "y2")


@query("SELECT eco, count(*) AS corners, min(lon) AS x1, min(lat) AS y1, max(lon) AS x2, max(lat) AS y2, round(sum(length), 6) AS length FROM (SELECT *, coalesce(sqrt(pow(lon - lag(lon) OVER w, 2) + pow(lat - lag(lat) OVER w, 2)), 0) AS length FROM tiles WINDOW w AS (PARTITION BY eco ORDER BY seen, tile)) GROUP BY eco")
def geo_npoints(spark, d):
    """Corners, envelope and planar length of each region's track."""
    points = _tracks(spark, d)
    after = points.select(F.col("eco").alias("e"), (F.col("place") - 1).alias("p"), F.col("x").alias("u"), F.col("y").alias("v"))
    steps = points.join(after, (F.col("eco") == F.col("e")) & (F.col("place") == F.col("p")), "left")
    length = F.coalesce(F.sqrt(F.pow(F.col("u") - F.col("x"), 2) + F.pow(F.col("v") - F.col("y"), 2)), F.lit(0.0))
    box = [f(c).alias(n) for f, c, n in zip(_BOUNDS, ("x", "y", "x", "y"), ("x1", "y1", "x2", "y2"), strict=True)]
    return steps.groupBy("eco").agg(F.count(F.lit(1)).alias("corners"), *box, F.round(F.sum(length), 6).alias("length"))


@query("SELECT tile FROM tiles WHERE abs(lon) + abs(lat) < 30.005")
def geo_ray_cast(spark, d):
    diamond = geo.ring([(-30.005, 0), (0, -30.005), (30.005, 0), (0, 30.005)])
    return tiles(spark, d).where(geo.contains(diamond, F.col("lon"), F.col("lat"))).select("tile")


@query("SELECT tile, round(2 * 111.32 * cos(radians(lat + 0.5)) * 1 * 111.32 * 0.7, 6) AS km2 FROM tiles")
def geo_approx_area(spark, d):
    x, y = F.col("lon"), F.col("lat")
    return tiles(spark, d).select("tile", F.round(geo.rough_area(x, y, x + 2, y + 1), 6).alias("km2"))


@query("SELECT tile, round(lon + 2, 6) AS x, round(lat + 1.5, 6) AS y FROM tiles")
def geo_centroid(spark, d):
    x, y = F.col("lon"), F.col("lat")
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    c = geo.centroid(F.array(p(x, y), p(x + 4, y), p(x + 4, y + 3), p(x, y + 3)))
    return tiles(spark, d).select("tile", F.round(c["x"], 6).alias("x"), F.round(c["y"], 6).alias("y"))



@query(_Q + f", s AS (SELECT taxon, cluster, occurrences, {_COS} AS sim FROM centroids, q WHERE elevation BETWEEN 100 AND 1500), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY taxon ORDER BY sim DESC, cluster) AS k FROM s) WHERE k = 1) SELECT b.taxon, name, round(sim, 6) AS similarity, (SELECT CAST(sum(occurrences) AS BIGINT) FROM centroids c WHERE c.taxon = b.taxon) AS occurrences, CASE WHEN sim >= 0.9 THEN 'excellent' WHEN sim >= 0.8 THEN 'good' WHEN sim >= 0.7 THEN 'moderate' WHEN sim >= 0.6 THEN 'marginal' ELSE 'poor' END AS quality FROM b LEFT JOIN species USING (taxon) WHERE sim >= 0 ORDER BY sim DESC, b.taxon LIMIT 5")
def q_predict(spark, d):
    return predict(centroids(spark, d), species(spark, d), 0.0, 5, 100, 1500)


def predict(c, s, least: float, k: int, low=None, high=None):
    """Best cluster of each taxon among those in the elevation range, then the threshold, then the best k; elevations
    that are unknown drop out only where a bound is given."""
    from arborlens.operators.relational import match_quality, optional

    rows = vector.similar_to(optional(c, "elevation", low, high), _query(c))
    best = best_per_group(rows, ["taxon"], F.col("similarity").desc(), F.col("cluster")).where(F.col("similarity") >= least)
    best = top(best.select("taxon", "similarity"), k, F.col("similarity").desc(), F.col("taxon"))
    sums = c.groupBy("taxon").agg(F.sum("occurrences").alias("occurrences"))
    best = best.join(sums, "taxon").join(s.select("taxon", "name"), "taxon", "left")
    return best.select("taxon", "name", F.round("similarity", 6).alias("similarity"), "occurrences", match_quality(F.col("similarity")).alias("quality"))


@query(_Q + f", s AS (SELECT taxon, max({_COS}) AS sim FROM centroids, q GROUP BY taxon) SELECT taxon, round(0.5 * sim + CASE WHEN native LIKE '%PROMO%' THEN 0.2 WHEN introduced IS NOT NULL THEN -0.1 ELSE 0 END + CASE WHEN size % 2 = 0 THEN 0.1 ELSE 0 END + 0.3, 6) AS score FROM s JOIN species USING (taxon) WHERE sim >= 0.05")
def q_recommend(spark, d):
    c = centroids(spark, d)
    best = vector.similar_to(c, _query(c)).groupBy("taxon").agg(F.max("similarity").alias("sim")).where("sim >= 0.05")
    rows = best.join(species(spark, d), "taxon")
    boost = F.when(F.col("native").like("%PROMO%"), 0.2).when(F.col("introduced").isNotNull(), -0.1).otherwise(0.0)
    goal = F.when(F.col("size") % 2 == 0, 0.1).otherwise(0.0)
    return rows.select("taxon", F.round(0.5 * F.col("sim") + boost + goal + 0.3, 6).alias("score"))


@query(f", q AS (SELECT cluster AS sample, v AS q FROM centroids WHERE cluster < 12), s AS (SELECT sample, taxon, max({_COS}) AS sim FROM centroids, q GROUP BY 1, 2) SELECT taxon, count(*) AS samples, round(avg(sim), 6) AS mean, round(0.6 * avg(sim) + 0.4 * count(*) / 12.0, 6) AS score FROM s WHERE sim >= 0.2 GROUP BY taxon")
def q_polygon(spark, d):
    """All sample points of a polygon at once: one join, one aggregate."""
    c = centroids(spark, d)
    asked = c.where("cluster < 12").select(F.col("cluster").alias("sample"), F.col("v").alias("q"))
    best = vector.similar_to(c, asked).groupBy("sample", "taxon").agg(F.max("similarity").alias("sim")).where("sim >= 0.2")
    n = F.count(F.lit(1))
    return best.groupBy("taxon").agg(n.alias("samples"), F.round(F.avg("sim"), 6).alias("mean"), F.round(0.6 * F.avg("sim") + 0.4 * n / 12.0, 6).alias("score"))


@query("SELECT taxon, cluster, occurrences, round(occurrences * 1.0 / sum(occurrences) OVER (PARTITION BY taxon), 6) AS share FROM centroids")
def q_emb_centroids(spark, d):
    share = F.col("occurrences") / F.sum("occurrences").over(Window.partitionBy("taxon"))
    return centroids(spark, d).select("taxon", "cluster", "occurrences", F.round(share, 6).alias("share"))


@query("SELECT count(*) AS centroids, count(DISTINCT taxon) AS taxa, CAST(sum(occurrences) AS BIGINT) AS embeddings FROM centroids")
def q_emb_stats(spark, d):
    return centroids(spark, d).agg(F.count(F.lit(1)).alias("centroids"), F.countDistinct("taxon").alias("taxa"), F.sum("occurrences").alias("embeddings"))
