"""Spatial joins as equality joins on grid cells, with the exact test as a residual.

Shapes are covered with the cells that their boxes meet, so a pair is compared only where both touch a cell; a pair that
shares several cells counts in the one that holds the lower corner of its common part. The cell size trades copies of
large shapes against pairs in a cell; a crowded cell is an ordinary skewed key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlens.workspace import materialize


def _cells(low: str, high: str, cell: float) -> Column:
    at = lambda c: F.floor(F.col(c) / cell)
    return F.explode(F.sequence(at(low), at(high)))


def _gridded(boxes: DataFrame, cell: float) -> DataFrame:
    return boxes.withColumn("cx", _cells("x1", "x2", cell)).withColumn("cy", _cells("y1", "y2", cell))


def boxes_meeting(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Pairs of left (x1, y1, x2, y2, ...) and right (u1, v1, u2, v2, ...) boxes that meet, edges included."""
    a = _gridded(left, cell)
    b = right.withColumn("cx", _cells("u1", "u2", cell)).withColumn("cy", _cells("v1", "v2", cell))
    pairs = a.join(b, ["cx", "cy"]).where("x1 <= u2 and x2 >= u1 and y1 <= v2 and y2 >= v1")
    first = (F.col("cx") == F.floor(F.greatest("x1", "u1") / cell)) & (F.col("cy") == F.floor(F.greatest("y1", "v1") / cell))
    return pairs.where(first).drop("cx", "cy")


def _other(boxes: DataFrame, key: str, name: str) -> DataFrame:
    return boxes.select(F.col(key).alias(name), F.col("x1").alias("u1"), F.col("y1").alias("v1"), F.col("x2").alias("u2"), F.col("y2").alias("v2"))


def boxes_that_meet(boxes: DataFrame, key: str, cell: float) -> DataFrame:
    """(a, b) of all ordered pairs of boxes in one table that meet, each with itself included."""
    return boxes_meeting(boxes.withColumnRenamed(key, "a"), _other(boxes, key, "b"), cell)


def points_in_boxes(points: DataFrame, boxes: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    """Points with every box that holds them; a point lies in one cell, so no pair comes twice."""
    p = points.withColumn("cx", F.floor(F.col(x) / cell)).withColumn("cy", F.floor(F.col(y) / cell))
    hit = (F.col(x) >= F.col("x1")) & (F.col(x) <= F.col("x2")) & (F.col(y) >= F.col("y1")) & (F.col(y) <= F.col("y2"))
    return p.join(_gridded(boxes, cell), ["cx", "cy"]).where(hit).drop("cx", "cy")


def largest_overlap(left: DataFrame, right: DataFrame, left_key: str, right_key: str, cell: float) -> DataFrame:
    """For each left box the right box with the largest common planar area, ties by key."""
    pairs = boxes_meeting(left, _other(right, right_key, right_key), cell)
    area = (F.least("x2", "u2") - F.greatest("x1", "u1")) * (F.least("y2", "v2") - F.greatest("y1", "v1"))
    best = F.min_by(F.struct(right_key, "area"), F.struct(-F.col("area"), F.col(right_key)))
    return pairs.withColumn("area", area).groupBy(left_key).agg(best.alias("_b")).select(left_key, "_b.*")


def nearest(points: DataFrame, places: DataFrame, keys: list[str], place: str, x: str = "lon", y: str = "lat", cell: float | None = None) -> DataFrame:
    """keys, place, dist: the nearest place (x1, y1) of every point by planar distance, ties by place.

    Points look into the three by three cells around their own, whose width doubles from round to round. A place outside
    them is farther than one width, so a point whose best is no farther than that is done, and the others go on; the
    last width holds all places. The first width is the places' box over the root of their number. Points and places
    without coordinates take no part; no place, no row.
    """
    named = places.where(F.col("x1").isNotNull() & F.col("y1").isNotNull()).select(F.col(place).alias("_place"), F.col("x1").cast("double"), F.col("y1").cast("double"))
    named = materialize(named, "places")
    rows = materialize(points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")), "points")
    box = named.agg(F.min("x1"), F.max("x1"), F.min("y1"), F.max("y1"), F.count(F.lit(1))).first()
    ends = rows.agg(F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y")).first()
    if not box[4] or ends[0] is None:
        return rows.limit(0).select(*keys, F.lit(None).cast(named.schema["_place"].dataType).alias(place), F.lit(None).cast("double").alias("dist"))
    extent = max(max(box[1], ends[1]) - min(box[0], ends[0]), max(box[3], ends[3]) - min(box[2], ends[2]), 1e-9)
    width = cell or max(box[1] - box[0], box[3] - box[2], 1e-9) / max(1.0, box[4] ** 0.5)
    done = None
    while True:
        last = width >= extent
        at = lambda c, width=width: F.floor(F.col(c) / width)
        around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        look = rows.select(*keys, "_x", "_y", around.alias("_o")).select(*keys, "_x", "_y", (at("_x") + F.col("_o.i")).alias("_cx"), (at("_y") + F.col("_o.j")).alias("_cy"))
        here = named.select("_place", "x1", "y1", at("x1").alias("_cx"), at("y1").alias("_cy"))
        dist = F.sqrt(F.pow(F.col("_x") - F.col("x1"), 2) + F.pow(F.col("_y") - F.col("y1"), 2))
        met = look.join(here, ["_cx", "_cy"], "left").withColumn("_d", dist)
        met = materialize(met.groupBy(*keys, "_x", "_y").agg(F.min_by(F.when(F.col("_d").isNotNull(), F.struct(F.col("_place").alias(place), F.col("_d").alias("dist"))), F.when(F.col("_d").isNotNull(), F.struct("_d", "_place"))).alias("_b")), "met")
        sure = F.coalesce(F.col("_b.dist") <= width, F.lit(False)) if not last else F.col("_b").isNotNull()
        own = met.where(sure).select(*keys, "_b.*")
        done = own if done is None else done.unionByName(own)
        rows = met.where(~sure).select(*keys, "_x", "_y")
        if last or rows.isEmpty():
            return done
        width *= 2
