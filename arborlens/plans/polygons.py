"""Polygon queries: union, repair, and what polygons have in common with regions.

A tile's shape is a box on a lattice of quarter degrees, so SQL can count lattice cells: area, corners, and outer rings
less holes (cells less inner sides plus inner points)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.functions import geo
from arborlens.operators import overlay
from arborlens.operators.relational import top
from arborlens.plans.analogue import occ, species, table, tiles
from arborlens.plans.composites import _LEAF_SQL, _leaf
from arborlens.plans.registry import query

#: Side of the grid's cells, in degrees: some ten shapes of a region in each at the sizes of the given tables.
CELL = 20.0
#: A concave polygon with a hole.
PLOT = (((0, -20), (40, -20), (40, 0), (20, 0), (20, 20), (0, 20)), ((5, -10), (10, -10), (10, -5), (5, -5)))
_IN_PLOT = "{x} >= 0 AND {x} < 40 AND {y} >= -20 AND {y} < 20 AND NOT ({x} >= 20 AND {y} >= 0) AND NOT ({x} >= 5 AND {x} < 10 AND {y} >= -10 AND {y} < -5)"
_PLOT_AREA = 1175.0

_CELLS = """cell AS (SELECT DISTINCT {key}, CAST(floor(lon * 4) AS BIGINT) + i AS cx, CAST(floor(lat * 4) AS BIGINT) + j AS cy
  FROM {source}, range(6) AS a(i), range(4) AS b(j))"""
_SHAPE_SQL = """side AS (
  SELECT a.{key}, count(*) AS n, count(r.cx) + count(u.cx) AS inner_sides, count(CASE WHEN r.cx IS NOT NULL AND u.cx IS NOT NULL THEN d.cx END) AS inner_points,
    min(a.cx) / 4.0::DOUBLE AS x1, min(a.cy) / 4.0::DOUBLE AS y1, max(a.cx + 1) / 4.0::DOUBLE AS x2, max(a.cy + 1) / 4.0::DOUBLE AS y2
  FROM cell a LEFT JOIN cell r ON a.{key} = r.{key} AND r.cx = a.cx + 1 AND r.cy = a.cy LEFT JOIN cell u ON a.{key} = u.{key} AND u.cx = a.cx AND u.cy = a.cy + 1
    LEFT JOIN cell d ON a.{key} = d.{key} AND d.cx = a.cx + 1 AND d.cy = a.cy + 1
  GROUP BY a.{key}
), corner AS (
  SELECT {key}, CAST(sum(CASE WHEN bit_count(mask) IN (1, 3) THEN 1 WHEN mask IN (6, 9) THEN 2 ELSE 0 END) AS BIGINT) AS corners FROM (
    SELECT {key}, cx + i AS vx, cy + j AS vy, CAST(sum(1 << CAST(2 * i + j AS INTEGER)) AS INTEGER) AS mask FROM cell, range(2) AS a(i), range(2) AS b(j) GROUP BY 1, 2, 3
  ) GROUP BY {key}
)"""
_SHAPES = "round(CAST(n * 0.0625 AS DOUBLE), 6) AS area, corners, n - inner_sides + inner_points AS rings_less_holes"


def _boxes(rows: DataFrame, *keys: str) -> DataFrame:
    """The shapes of tiles: one and a half by one degree, from the quarter degree at or below the tile's point."""
    x, y = F.floor(F.col("lon") * 4) / 4, F.floor(F.col("lat") * 4) / 4
    return rows.select(*keys, overlay.box_rings(x, y, x + 1.5, y + 1).alias("rings"))


def _plot(spark) -> DataFrame:
    """The plot, as one row of rings."""
    return spark.range(1).select(F.lit(0).alias("plot"), F.array(*[geo.ring(r) for r in PLOT]).alias("rings"))


def _shape_rows(paths: DataFrame, keys: list[str]) -> DataFrame:
    sizes = overlay.ring_sizes(overlay.rings(paths, keys), keys).groupBy(*keys)
    less = (F.count_if(F.col("area") > 0) - F.count_if(F.col("area") < 0)).alias("rings_less_holes")
    return sizes.agg(F.round(F.sum("area"), 6).alias("area"), F.sum("corners").alias("corners"), less)


def _regions_in_plot(spark, d) -> DataFrame:
    """eco, area: what the union of each region's tiles covers of the plot."""
    near = tiles(spark, d).where("lon between -2 and 40 and lat between -22 and 20")
    both = overlay.common(_boxes(near, "eco"), _plot(spark), ["eco"], ["plot"], CELL)
    return overlay.areas(both, ["eco"]).select("eco", F.round("area", 6).alias("area")).where("area > 0")


_PLOT_CELLS = _CELLS.format(key="eco", source="tiles") + f""", share AS (
  SELECT eco, CAST(count(*) * 0.0625 AS DOUBLE) AS area FROM cell WHERE {_IN_PLOT.format(x='(cx / 4.0)', y='(cy / 4.0)')} GROUP BY eco)"""


@query(", " + _CELLS.format(key="eco", source="tiles") + ", " + _SHAPE_SQL.format(key="eco") + f" SELECT eco, {_SHAPES}, x1, y1, x2, y2 FROM side JOIN corner USING (eco)")
def agg_spatial_union(spark, d):
    """The union of each region's overlapping and touching tiles: area, corners, outer rings less holes, and envelope."""
    paths = overlay.dissolve(_boxes(tiles(spark, d), "eco"), ["eco"], CELL)
    return _shape_rows(paths, ["eco"]).join(overlay.areas(paths, ["eco"]).drop("area"), "eco")


@query(", " + _CELLS.format(key="realm", source="(SELECT n_regionkey AS realm, lon, lat FROM tiles JOIN nation ON eco = n_nationkey)") + ", " + _SHAPE_SQL.format(key="realm") + f" SELECT realm, {_SHAPES} FROM side JOIN corner USING (realm)")
def geo_dissolve(spark, d):
    """Regions dissolved to realms."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("eco"), F.col("n_regionkey").alias("realm"))
    return _shape_rows(overlay.dissolve(_boxes(tiles(spark, d).join(n, "eco"), "realm"), ["realm"], CELL), ["realm"])


_VIEW = (-50, -40, 50, 40)


@query(", whole AS (SELECT DISTINCT eco, CAST(floor(lon * 4) AS BIGINT) + i AS cx, CAST(floor(lat * 4) AS BIGINT) + j AS cy FROM tiles, range(6) AS a(i), range(4) AS b(j)), cell AS (SELECT * FROM whole WHERE cx >= -200 AND cx < 200 AND cy >= -160 AND cy < 160), " + _SHAPE_SQL.format(key="eco") + f" SELECT eco, {_SHAPES} FROM side JOIN corner USING (eco)")
def q_ecoregion_boundaries(spark, d):
    """The outlines of regions in a view, dissolved and clipped to it."""
    x1, y1, x2, y2 = _VIEW
    near = tiles(spark, d).where(F.col("lon").between(x1 - 2, x2) & F.col("lat").between(y1 - 2, y2))
    view = spark.range(1).select(F.lit(0).alias("view"), F.array(geo.ring([(x1, y1), (x2, y1), (x2, y2), (x1, y2)])).alias("rings"))
    return _shape_rows(overlay.common(_boxes(near, "eco"), view, ["eco"], ["view"], CELL), ["eco"])


@query(", " + _PLOT_CELLS + f" SELECT eco, area, round(area * 100 / {_PLOT_AREA}::DOUBLE, 6) AS coverage FROM share")
def q_ecoregion_intersect(spark, d):
    """How much of a concave polygon with a hole each region covers."""
    return _regions_in_plot(spark, d).withColumn("coverage", F.round(F.col("area") * 100 / _PLOT_AREA, 6))


@query(", " + _PLOT_CELLS + ", w AS (SELECT eco, CAST(area / sum(area) OVER () AS DOUBLE) AS weight FROM share), " + _LEAF_SQL)
def q_leaf_polygon(spark, d):
    """Taxa ranked for a polygon: every region that it meets, weighted by its share of the common area."""
    g = _regions_in_plot(spark, d)
    return _leaf(spark, d, g.crossJoin(g.agg(F.sum("area").alias("all"))).select("eco", (F.col("area") / F.col("all")).alias("weight")))


@query(", " + _PLOT_CELLS + f""", land AS (SELECT eco AS country, round(area / {_PLOT_AREA}::DOUBLE, 6) AS fraction FROM share ORDER BY area DESC, eco LIMIT 1),
g AS (SELECT taxon, CAST(sum(n) AS BIGINT) AS n, count(*) AS tiles FROM occ JOIN tiles USING (tile) WHERE {_IN_PLOT.format(x='(lon + 0.005)', y='(lat + 0.005)')} GROUP BY taxon),
s AS (SELECT g.*, native, introduced, intact, price, country, fraction, 'brand#' || CAST(country % 5 + 1 AS VARCHAR) AS place FROM g JOIN species USING (taxon), land)
SELECT taxon, n, tiles, country, fraction, CASE WHEN contains(lower(native), place) THEN CASE WHEN contains(lower(introduced), place) THEN 'native_and_introduced' ELSE 'native' END
  WHEN contains(lower(introduced), place) THEN 'introduced' ELSE 'unknown' END AS status,
CASE WHEN intact LIKE '%YES%' THEN 'present' WHEN intact = 'NO' THEN 'absent' ELSE 'unknown' END AS forest, price >= 1500 AS commercial FROM s""")
def q_analyze_plot(spark, d):
    """Taxa of the tiles in a plot, their status in the country that covers most of it, forest and commercial use."""
    x, y = F.col("lon") + 0.005, F.col("lat") + 0.005  # a tile's centre
    near = tiles(spark, d).where("lon between -1 and 40 and lat between -21 and 20")
    inside = near.where(geo.contains(geo.ring(PLOT[0]), x, y) & ~geo.contains(geo.ring(PLOT[1]), x, y)).select("tile")
    land = top(_regions_in_plot(spark, d), 1, F.col("area").desc(), F.col("eco"))
    land = land.select(F.col("eco").alias("country"), F.round(F.col("area") / _PLOT_AREA, 6).alias("fraction"), F.concat(F.lit("brand#"), (F.col("eco") % 5 + 1).cast("string")).alias("place"))
    g = occ(spark, d, inside).groupBy("taxon").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("tiles")).join(species(spark, d), "taxon").crossJoin(land)
    mentions = lambda c: F.coalesce(F.contains(F.lower(c), F.col("place")), F.lit(False))
    n, i, c = mentions("native"), mentions("introduced"), F.col("intact")
    status = F.when(n & i, "native_and_introduced").when(n, "native").when(i, "introduced").otherwise("unknown")
    forest = F.when(c.like("%YES%"), "present").when(c == "NO", "absent").otherwise("unknown")
    return g.select("taxon", "n", "tiles", "country", "fraction", status.alias("status"), forest.alias("forest"), (F.col("price") >= 1500).alias("commercial"))


_MESSY_SQL = "SELECT tile, lon AS x, lat AS y, CAST(1.0 + tile % 3 AS DOUBLE) AS w, CAST(1.0 + tile % 2 AS DOUBLE) AS h, tile % 4 AS kind FROM tiles"


def _messy(spark, d) -> DataFrame:
    """Rings as they come from careless sources: every fourth crosses itself, every fourth has a spike, every fourth repeats
    corners."""
    x, y = F.col("lon"), F.col("lat")
    w, h = (F.lit(1.0) + F.col("tile") % 3), (F.lit(1.0) + F.col("tile") % 2)
    p = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    a, b, c, e = p(x, y), p(x + w, y), p(x + w, y + h), p(x, y + h)
    kind = F.col("tile") % 4
    r = F.when(kind == 1, F.array(a, c, b, e)).when(kind == 2, F.array(a, b, c, p(x + w + 2, y + h), c, e)).when(kind == 3, F.array(a, a, b, c, c, e)).otherwise(F.array(a, b, c, e))
    return tiles(spark, d).select("tile", r.alias("r"))


@query(f", m AS ({_MESSY_SQL}) SELECT tile, CASE WHEN kind = 1 THEN 2 ELSE 1 END AS parts, round(w * h * CASE WHEN kind = 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END, 6) AS area, CASE WHEN kind = 1 THEN 6 ELSE 4 END AS corners FROM m")
def geo_geom_repair(spark, d):
    """Repaired shapes: a ring that crosses itself falls into parts, spikes and repeated corners go."""
    paths = overlay.repair(_messy(spark, d).select("tile", F.array("r").alias("rings")), ["tile"], CELL)
    return _shape_rows(paths, ["tile"]).select("tile", F.col("rings_less_holes").alias("parts"), "area", "corners")


@query(f", m AS ({_MESSY_SQL}) SELECT tile FROM m WHERE kind IN (0, 3)")
def flt_valid_geom(spark, d):
    """Rings with three corners and an area that neither cross nor turn back on themselves."""
    return _messy(spark, d).where(geo.valid_ring(F.col("r"))).select("tile")


@query("SELECT tile, round(greatest(least(lon + w, 30.0) - greatest(lon, 10.0), 0) * greatest(least(lat + h, 20.0) - greatest(lat, -10.0), 0), 6) AS shared FROM (SELECT tile, lon, lat, 1.0 + tile % 5 AS w, 1.0 + tile % 3 AS h FROM tiles WHERE lon <= 30 AND lon + (1.0 + tile % 5) >= 10 AND lat <= 20 AND lat + (1.0 + tile % 3) >= -10 ORDER BY (1 + tile % 5) * (1 + tile % 3) DESC, tile LIMIT 100)")
def q_intact_forest(spark, d):
    """The largest shapes in view by area, then clipped to it."""
    x, y, w, h = F.col("lon"), F.col("lat"), F.lit(1.0) + F.col("tile") % 5, F.lit(1.0) + F.col("tile") % 3
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    rows = tiles(spark, d).where(geo.boxes_meet(x, y, x + w, y + h, (10.0, -10.0, 30.0, 20.0)))
    rows = top(rows, 100, F.round(w * h, 6).desc(), F.col("tile"))
    rows = rows.select("tile", geo.clip_to_box((10.0, -10.0, 30.0, 20.0))(F.array(p(x, y), p(x + w, y), p(x + w, y + h), p(x, y + h))).alias("r"))
    return rows.select("tile", F.round(F.when(F.size("r") >= 3, geo.planar_area(F.col("r"))).otherwise(0.0), 6).alias("shared"))
