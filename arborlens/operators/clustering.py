"""Per-group k-means: a few centroids for each taxon."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlens.workspace import materialize


def _lloyd(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Assignments from centres that start at the row nearest the mean and then the farthest rows in turn."""
    centres = [x[np.argmin(((x - x.mean(0)) ** 2).sum(1))]]
    while len(centres) < k:
        far = np.min([((x - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(x[np.argmax(far)])
    c = np.array(centres)
    for _ in range(rounds):
        near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return near


def _distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def _mean(column: str, n: int) -> Column:
    return F.array(*[F.avg(F.col(column)[i]) for i in range(n)])


def _large(points: DataFrame, n: int, k: int, rounds: int) -> DataFrame:
    """(g, x, ...) -> the same with `cluster`: the rounds of _lloyd() as partial sums by group and cluster, so that a group
    with any share of the rows is no single task's. Only a row a group, its centres, is joined with the points."""
    apart = lambda: F.transform("centres", lambda c: _distance(F.col("x"), c))
    centres = points.groupBy("g").agg(_mean("x", n).alias("m"))
    near = points.join(centres, "g").groupBy("g").agg(F.min(F.struct(_distance(F.col("x"), F.col("m")).alias("d"), "x")).alias("b"))
    centres = materialize(near.select("g", F.array("b.x").alias("centres")), "centres")
    for _ in range(1, k):
        far = points.join(centres, "g").groupBy("g").agg(F.max(F.struct(F.array_min(apart()).alias("d"), "x")).alias("b"), F.any_value("centres").alias("c"))
        centres = materialize(far.select("g", F.concat("c", F.array("b.x")).alias("centres")), "centres")
    nearest = lambda rows: rows.join(centres, "g").withColumn("d", apart()).withColumn("cluster", F.array_position("d", F.array_min("d")).cast("int") - 1).drop("d")
    for _ in range(rounds):
        means = nearest(points).groupBy("g", "cluster").agg(_mean("x", n).alias("m"))
        means = means.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("cluster", "m"))).alias("means"))
        moved = centres.join(means, "g").withColumn("new", F.transform("centres", lambda c, j: F.coalesce(F.try_element_at("means", j), c)))
        moved = materialize(moved.select("g", F.col("centres").alias("old"), F.col("new").alias("centres")), "centres")
        shift = F.max(F.array_max(F.zip_with("old", "centres", lambda a, b: _distance(a, b))))
        still = (moved.agg(shift).first()[0] or 0.0) < 1e-12
        centres = moved.drop("old")
        if still:
            break
    return nearest(points).drop("centres")


def kmeans_per_group(rows: DataFrame, group: str, vector: str, extra: tuple[str, ...] = (), k: int = 5, rounds: int = 50, most: int = 20_000) -> DataFrame:
    """(group, cluster, size, centroid, mean of each extra column): k-means of each group's vectors, scaled by the whole
    table's means and population deviations and scaled back; fewer rows than k are centroids of their own.

    A group of at most `most` rows is one task's frame; a larger one goes through the same rounds as aggregates over all
    tasks, so it has k centroids too.
    """
    n = len(rows.first()[vector]) if rows.head(1) else 0
    stats = rows.agg(*[f(F.col(vector)[i]).alias(f"{p}{i}") for i in range(n) for p, f in (("m", F.avg), ("s", F.stddev_pop))]).first() if n else []
    mean, scale = np.array([stats[f"m{i}"] for i in range(n)]), np.array([stats[f"s{i}"] or 1.0 for i in range(n)])
    kinds = dict(rows.dtypes)
    schema = f"{group} {kinds[group]}, cluster int, size long, centroid array<double>" + "".join(f", {c} double" for c in extra)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        x = (np.stack(frame[vector].to_numpy()) - mean) / scale
        near = _lloyd(x, k, rounds) if len(x) >= k else np.arange(len(x))
        out = []
        for j in range(int(near.max()) + 1):
            own = near == j
            if own.any():
                out.append((frame[group].iloc[0], j, int(own.sum()), (x[own].mean(0) * scale + mean).tolist(), *[float(frame[c][own].mean()) for c in extra]))
        return pd.DataFrame(out, columns=[group, "cluster", "size", "centroid", *extra])

    sizes = materialize(rows.groupBy(F.col(group).alias("_g")).agg((F.count(F.lit(1)) > most).alias("_large")), "sizes")
    parted = rows.select(group, vector, *extra).join(sizes, F.col(group) == F.col("_g")).drop("_g")
    small = parted.where("not _large").drop("_large").groupBy(group).applyInPandas(fit, schema)
    if not sizes.where("_large").head(1):
        return small
    scaled = F.zip_with(vector, F.arrays_zip(F.array(*map(F.lit, mean.tolist())).alias("m"), F.array(*map(F.lit, scale.tolist())).alias("s")), lambda v, t: (v - t["m"]) / t["s"])
    points = materialize(parted.where("_large").select(F.col(group).alias("g"), scaled.alias("x"), F.struct(vector, *extra).alias("own")), "points")
    large = _large(points, n, k, rounds).select("g", "cluster", "own.*").groupBy("g", "cluster")
    large = large.agg(F.count(F.lit(1)).alias("size"), _mean(vector, n).alias("centroid"), *[F.avg(c).alias(c) for c in extra])
    return small.unionByName(large.withColumnRenamed("g", group))
