"""The flagship ranking of taxa for a set of regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlens.operators.relational import percentile_place


def affinities(occurrences: DataFrame, regions: DataFrame) -> DataFrame:
    """(tile, taxon, n) and (tile, eco, weight) -> (eco, weight, taxon, affinity): occurrences times tiles. One shuffle
    on (eco, taxon), combined before it."""
    rows = occurrences.join(regions, "tile").groupBy("eco", "weight", "taxon")
    return rows.agg((F.sum("n") * F.count(F.lit(1))).alias("affinity"))


def leaf_scores(
    occurrences: DataFrame, regions: DataFrame, natives: DataFrame, introduced: DataFrame, absent_affinity: int = 100,
    min_score: float = 0.0, limit: int = 2500,
) -> DataFrame:
    """taxon, affinity, native, leaf_score, best first.

    A taxon's affinity is the mean over the regions where it occurs, by the regions' weights; native taxa that occur
    nowhere have absent_affinity; natives count double; introduced taxa go, native or not. The score is the position in
    ascending order, ties by taxon. natives and introduced hold distinct taxa.
    """
    mean = affinities(occurrences, regions).groupBy("taxon").agg((F.sum(F.col("affinity") * F.col("weight")) / F.sum("weight")).alias("a"))
    rows = mean.join(natives.select("taxon", F.lit(True).alias("native")), "taxon", "full").join(introduced.select("taxon"), "taxon", "left_anti")
    native = F.coalesce("native", F.lit(False))
    # to nine decimals, as the order in which doubles are added must not part equal means
    value = F.round(F.coalesce("a", F.lit(float(absent_affinity))) * F.when(native, 2).otherwise(1), 9)
    rows = percentile_place(rows.select("taxon", value.alias("affinity"), native.alias("native")), "affinity", "taxon")
    rows = rows.withColumnRenamed("place", "leaf_score").where(F.col("leaf_score") >= min_score)
    return rows.orderBy(F.col("leaf_score").desc(), "taxon").limit(limit)


def quantity_bands(n: Column, bands: Sequence[tuple[int, int, str]], other: str = "other") -> Column:
    out = F.lit(other)
    for low, high, name in reversed(bands):
        out = F.when(n.between(low, high), name).otherwise(out)
    return out
