"""Windows, sorts, limits, paging and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from arborlens.functions import geo
from arborlens.operators.relational import best_per_group, page, percentile_place, pick_per_group, stratified, top
from arborlens.plans.analogue import centroids, claims, occ, species, table, tiles
from arborlens.plans.registry import query


@query("SELECT taxon, cluster FROM (SELECT *, row_number() OVER (PARTITION BY taxon ORDER BY abs(v[1]), cluster) AS k FROM centroids) WHERE k = 1")
def win_best_per_group(spark, d):
    return best_per_group(centroids(spark, d), ["taxon"], F.abs(F.col("v")[0]), F.col("cluster")).select("taxon", "cluster")


@query("SELECT taxon, id, row_number() OVER (PARTITION BY taxon ORDER BY id) = 1 AS is_primary FROM claims WHERE current")
def win_dedupe_primary(spark, d):
    first = claims(spark, d).where("current").groupBy("taxon").agg(F.min("id").alias("first"))
    rows = claims(spark, d).where("current").select("taxon", "id").join(first, "taxon")
    return rows.select("taxon", "id", (F.col("id") == F.col("first")).alias("is_primary"))


@query("SELECT taxon, name || '-' || lpad(CAST(CASE WHEN subspecies = 'NA' THEN 0 ELSE row_number() OVER (PARTITION BY name, subspecies = 'NA' ORDER BY subspecies, taxon) END AS VARCHAR), 2, '0') AS code FROM species")
def win_seq_assign(spark, d):
    main = F.col("subspecies") == "NA"
    n = F.row_number().over(Window.partitionBy("name", main).orderBy("subspecies", "taxon"))
    return species(spark, d).select("taxon", F.concat_ws("-", "name", F.lpad(F.when(main, 0).otherwise(n).cast("string"), 2, "0")).alias("code"))


@query("SELECT l_partkey, l_suppkey, arg_max(l_orderkey, (l_shipdate, l_orderkey)) AS latest FROM lineitem GROUP BY 1, 2")
def win_dedupe_embeddings(spark, d):
    latest = F.max_by("l_orderkey", F.struct("l_shipdate", "l_orderkey"))
    return table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(latest.alias("latest"))


@query("SELECT eco, taxon, floor(CASE WHEN m = 1 THEN 100.0 ELSE i * 100.0 / (m - 1) END * 10 + 0.5) / 10 AS place FROM (SELECT eco, taxon, row_number() OVER (PARTITION BY eco ORDER BY n, taxon) - 1 AS i, count(*) OVER (PARTITION BY eco) AS m FROM (SELECT eco, taxon, sum(n) AS n FROM occ JOIN tiles USING (tile) GROUP BY 1, 2))")
def win_percentile_position(spark, d):
    rows = occ(spark, d).join(tiles(spark, d).select("tile", "eco"), "tile").groupBy("eco", "taxon").agg(F.sum("n").alias("n"))
    return percentile_place(rows, "n", "taxon", ["eco"]).select("eco", "taxon", "place")


@query("SELECT eco, taxon, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY eco), 9) AS share FROM (SELECT eco, taxon, sum(n) AS n FROM occ JOIN tiles USING (tile) GROUP BY 1, 2)")
def win_fraction_of_total(spark, d):
    rows = occ(spark, d).join(tiles(spark, d).select("tile", "eco"), "tile").groupBy("eco", "taxon").agg(F.sum("n").alias("n"))
    return rows.select("eco", "taxon", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("eco")), 9).alias("share"))


@query("SELECT taxon, cluster, round(occurrences * 1.0 / max(occurrences) OVER (PARTITION BY taxon), 9) AS confidence FROM centroids")
def win_norm_by_max(spark, d):
    most = F.max("occurrences").over(Window.partitionBy("taxon"))
    return centroids(spark, d).select("taxon", "cluster", F.round(F.col("occurrences") / most, 9).alias("confidence"))


@query("SELECT DISTINCT ON (name) name, taxon, family FROM species ORDER BY name, size DESC, taxon")
def win_distinct_on(spark, d):
    return pick_per_group(species(spark, d), ["name"], F.struct(-F.col("size"), F.col("taxon")), "taxon", "family")


@query("SELECT taxon, name FROM species WHERE name ILIKE '%ring%' ORDER BY CASE WHEN name ILIKE 'blue%' THEN 0 WHEN name ILIKE 'red%' THEN 1 ELSE 2 END, taxon LIMIT 20")
def srt_case_rank(spark, d):
    c = F.col("name")
    rows = species(spark, d).where(c.ilike("%ring%"))
    return top(rows, 20, F.when(c.ilike("blue%"), 0).when(c.ilike("red%"), 1).otherwise(2), F.col("taxon")).select("taxon", "name")


@query("SELECT cluster, elevation FROM centroids ORDER BY elevation DESC NULLS LAST, taxon ASC NULLS LAST, cluster LIMIT 480")
def srt_nulls(spark, d):
    return top(centroids(spark, d), 480, F.col("elevation").desc_nulls_last(), F.col("taxon").asc_nulls_last(), F.col("cluster")).select("cluster", "elevation")


@query("SELECT s.taxon, n FROM species s LEFT JOIN (SELECT taxon, CAST(sum(n) AS BIGINT) AS n FROM occ GROUP BY taxon) o ON s.taxon = o.taxon WHERE s.intact <> 'YES' ORDER BY n DESC NULLS LAST, s.taxon LIMIT 50")
def srt_unresearched(spark, d):
    """Ordered as numbers (the reference orders the same counts as text)."""
    sums = occ(spark, d).groupBy("taxon").agg(F.sum("n").alias("n"))
    rows = species(spark, d).where("intact <> 'YES'").select("taxon").join(sums, "taxon", "left")
    return top(rows, 50, F.col("n").desc_nulls_last(), F.col("taxon")).select("taxon", "n")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 20")
def srt_priority_queue(spark, d):
    rows = table(spark, d, "orders").where("o_orderstatus = 'P'")
    return top(rows, 20, F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_orderkey")).select("o_orderkey", "o_orderpriority")


@query("SELECT taxon, CASE WHEN native IS NOT NULL THEN 0 WHEN introduced IS NOT NULL THEN 1 ELSE 2 END AS first FROM species ORDER BY first, price DESC, taxon LIMIT 100")
def srt_client_native_first(spark, d):
    first = F.when(F.col("native").isNotNull(), 0).when(F.col("introduced").isNotNull(), 1).otherwise(2)
    return top(species(spark, d).withColumn("first", first), 100, F.col("first"), F.col("price").desc(), F.col("taxon")).select("taxon", "first")


@query("SELECT taxon, family FROM species ORDER BY family DESC, taxon LIMIT 30")
def srt_generic(spark, d):
    return top(species(spark, d), 30, F.col("family").desc(), F.col("taxon")).select("taxon", "family")


@query("SELECT taxon, name FROM species ORDER BY name, taxon LIMIT 40 OFFSET 80")
def lim_paging(spark, d):
    return page(species(spark, d), 3, 40, F.col("name"), F.col("taxon")).select("taxon", "name")


@query("SELECT tile, eco FROM tiles WHERE lon BETWEEN -20 AND 60 ORDER BY eco DESC, tile LIMIT 300")
def lim_by_zoom(spark, d):
    limits = ((4, 100), (6, 200), (8, 300), (99, 500))
    most = next(n for zoom, n in limits if zoom >= 8)
    return top(tiles(spark, d).where("lon between -20 and 60"), most, F.col("eco").desc(), F.col("tile")).select("tile", "eco")


@query("SELECT taxon FROM species ORDER BY taxon LIMIT 500")
def lim_clamp(spark, d):
    return page(species(spark, d), 0, 9999, F.col("taxon")).select("taxon")


_FIRST = "a AS (SELECT taxon, genus FROM (SELECT *, row_number() OVER (PARTITION BY genus ORDER BY md5('s1' || taxon), taxon) AS k FROM species) WHERE k <= 6)"


@query(f", {_FIRST}, b AS (SELECT taxon, genus FROM (SELECT *, row_number() OVER (PARTITION BY genus ORDER BY md5('s2' || taxon), taxon) AS k FROM species WHERE taxon NOT IN (SELECT taxon FROM a)) WHERE k <= 4) SELECT taxon, genus, 1 AS round FROM a UNION ALL SELECT taxon, genus, 2 FROM b")
def smp_random_stratified(spark, d):
    s = species(spark, d)
    a = stratified(s, "genus", "taxon", 6, "s1").select("taxon", "genus", F.lit(1).alias("round"))
    return a.unionByName(stratified(s, "genus", "taxon", 4, "s2", exclude=a).select("taxon", "genus", F.lit(2).alias("round")))


@query(", q(genus, quota) AS (VALUES ('ECONOMY', 5), ('PROMO', 3), ('LARGE', 2)), c AS (SELECT taxon, count(*) AS tiles FROM occ GROUP BY taxon) SELECT taxon, genus, tiles FROM (SELECT s.taxon, s.genus, c.tiles, quota, row_number() OVER (PARTITION BY s.genus ORDER BY c.tiles DESC, s.taxon) AS k FROM species s JOIN c USING (taxon) JOIN q USING (genus)) WHERE k <= quota")
def smp_top_stratified(spark, d):
    quota = F.create_map(F.lit("ECONOMY"), F.lit(5), F.lit("PROMO"), F.lit(3), F.lit("LARGE"), F.lit(2))
    counts = occ(spark, d).groupBy("taxon").agg(F.count(F.lit(1)).alias("tiles"))
    rows = species(spark, d).select("taxon", "genus", F.try_element_at(quota, F.col("genus")).alias("quota")).where("quota is not null").join(counts, "taxon")
    place = F.row_number().over(Window.partitionBy("genus").orderBy(F.col("tiles").desc(), "taxon"))
    return rows.withColumn("k", place).where("k <= quota").select("taxon", "genus", "tiles")


@query("SELECT taxon, tile FROM (SELECT *, row_number() OVER (PARTITION BY taxon ORDER BY md5('42' || tile), tile) AS k FROM occ) WHERE k <= 5")
def smp_cap_per_group(spark, d):
    return stratified(occ(spark, d), "taxon", "tile", 5, "42").select("taxon", "tile")


@query(", g AS (SELECT CAST(ceil(sqrt(2.0 * n_nationkey + 2)) AS BIGINT) AS grid, n_nationkey + 1 AS n FROM nation), p AS (SELECT n, (j.range + 1.0) / (grid + 1) AS x, (i.range + 1.0) / (grid + 1) AS y, row_number() OVER (PARTITION BY n ORDER BY i.range, j.range) AS k FROM g, range(0, 9) i, range(0, 9) j WHERE i.range < grid AND j.range < grid) SELECT n, k, round(x, 9) AS x, round(y, 9) AS y FROM p WHERE k <= n")
def smp_grid_polygon(spark, d):
    """Grid samples of the unit square, twice as many as asked for, row by row until enough lie inside."""
    grid = F.ceil(F.sqrt(2.0 * F.col("n"))).cast("int")
    rows = table(spark, d, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("n")).withColumn("grid", grid)
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("grid")))).withColumn("j", F.explode(F.sequence(F.lit(1), F.col("grid"))))
    x, y = F.col("j") / (F.col("grid") + 1), F.col("i") / (F.col("grid") + 1)
    square = geo.ring([(0, 0), (1, 0), (1, 1), (0, 1)])
    rows = rows.withColumns({"x": x, "y": y}).where(geo.contains(square, F.col("x"), F.col("y")))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("n").orderBy("i", "j")).cast("long")).where("k <= n")
    return rows.select("n", "k", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query(", p AS (SELECT n_nationkey AS shape, t.range AS t, CAST(('0x' || substr(md5(n_nationkey || ':' || t.range), 1, 7)) AS BIGINT) / 268435456.0 AS x, CAST(('0x' || substr(md5(n_nationkey || ':' || t.range), 8, 7)) AS BIGINT) / 268435456.0 AS y FROM nation, range(0, 50) t) SELECT shape, t, round(x, 9) AS x, round(y, 9) AS y FROM (SELECT *, row_number() OVER (PARTITION BY shape ORDER BY t) AS k FROM p WHERE x + y < 1) WHERE k <= 5")
def smp_random_polygon(spark, d):
    """Rejection sampling with a seeded hash: ten tries for each wanted point, the first hits kept."""
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("shape"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))).alias("t"))
    h = F.md5(F.concat_ws(":", F.col("shape").cast("string"), F.col("t").cast("string")))
    unit = lambda at: F.conv(F.substring(h, at, 7), 16, 10).cast("double") / 268435456.0
    rows = rows.withColumns({"x": unit(1), "y": unit(8)}).where(geo.contains(geo.ring([(0, 0), (1, 0), (0, 1)]), F.col("x"), F.col("y")))
    return best_per_group(rows, ["shape"], F.col("t"), n=5).select("shape", "t", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))
