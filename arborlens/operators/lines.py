"""Lines of any length: places along them, and thinning by pieces."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlens.functions.geo import _simplified
from arborlens.workspace import materialize


def numbered(points: DataFrame, key: str, part: Column, order: Sequence[str], name: str = "place") -> DataFrame:
    """points with `name`, 0 for the first of its key by (part, *order): part cuts a line into stretches that follow one another,
    for instance days, and only the stretches' sizes meet for the whole line."""
    rows = points.withColumn("_part", part)
    sizes = rows.groupBy(F.col(key).alias("_k"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_k", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)) - 1
    rows = rows.withColumn("_own", own).join(sizes, F.col(key).eqNullSafe(F.col("_k")) & F.col("_part").eqNullSafe(F.col("_p")))
    return rows.withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_part", "_own", "_k", "_p", "_before")


def thinned(points: DataFrame, key: str, place: str, x: str, y: str, tolerance: float, piece: int = 4096) -> DataFrame:
    """key, place, x, y of the points that a line keeps, so that all others lie within `tolerance` of it.

    Twice thinned by Douglas-Peucker at half the tolerance, in pieces of `piece` points: the ends of pieces stay the first
    time, and the second time pieces are shifted by half their length, so that those ends can go. A line's own ends
    stay. No task holds more than a piece.
    """
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}

    def once(rows: DataFrame, at: str, shift: int) -> DataFrame:
        rows = rows.withColumn("_piece", F.floor((F.col(at) + shift) / piece))
        schema = f"`{key}` {kinds[key]}, `{place}` long, `{x}` double, `{y}` double"

        def thin(table: pa.Table) -> pa.Table:
            rows = sorted(zip(*[table.column(c).to_pylist() for c in (at, place, x, y)], strict=True))
            if len(rows) > 2:
                kept = set(_simplified([(a, b) for *_, a, b in rows], tolerance / 2))
                inner, last = [], None
                for r in rows[1:-1]:  # a kept point stands for all that are equal to it
                    if r[2:] in kept and r[2:] != last:
                        inner.append(r)
                    last = r[2:]
                rows = [rows[0], *inner, rows[-1]]
            constants = pa.array([table.column(key)[0].as_py()] * len(rows), table.schema.field(key).type)
            return pa.table([constants, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.float64())], names=[key, place, x, y])

        return rows.select(key, "_piece", at, *([place] if at != place else []), F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).groupBy(key, "_piece").applyInArrow(thin, schema)

    first = materialize(once(points.where(F.col(x).isNotNull() & F.col(y).isNotNull()), place, 0), "thinned")
    again = numbered(first, key, F.floor(F.col(place) / piece), [place], "_at")
    return once(again, "_at", piece // 2)
