"""Nearest vectors by an index of inverted lists under trained centroids, without loss: lists are probed by nearness, and
what cannot hold a nearer vector is left out."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.operators.relational import best_per_group
from arborlens.workspace import materialize

#: Vectors that one task holds of a list; a longer list is parted.
PART = 4096


def train(vectors: DataFrame, lists: int, seed: int = 1, sample: int = 64) -> np.ndarray:
    """Centroids of `lists` lists, by k-means over at most lists x sample vectors (the documented bound), chosen by a hash."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    some = vectors.orderBy(F.xxhash64(F.lit(seed), "id")).limit(lists * sample)
    some = materialize(some.select(array_to_vector("v").alias("features")), "sample")
    model = KMeans(k=lists, maxIter=10, seed=seed).fit(some)
    return np.array(model.clusterCenters())


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all of b."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def build(vectors: DataFrame, lists: int | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(id, v) -> the written index (id, v, list, part, away: distance to the list's centroid), its lists (list, parts, n,
    radius), and the centroids. About the square root of their number of lists, 4,096 at most; larger tables have longer
    lists. Null and empty vectors are left out."""
    rows = vectors.where(F.size("v") > 0).select("id", F.col("v").cast("array<double>").alias("v"))
    lists = lists or max(1, min(4096, math.isqrt(rows.count())))
    centres = train(rows, lists, seed)

    def assign(batches):
        for b in batches:
            v = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, -1)
            if not len(v):
                continue
            d = _distances(v, centres)
            near = d.argmin(1)
            away = np.sqrt(((v - centres[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near), pa.array(away)], names=["id", "v", "list", "away"])

    kind = rows.schema["id"].dataType.simpleString()
    index = materialize(rows.mapInArrow(assign, f"id {kind}, v array<double>, list long, away double"), "lists")
    sizes = index.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
    sizes = materialize(sizes.withColumn("parts", F.ceil(F.col("n") / PART)), "sizes")
    index = index.join(F.broadcast(sizes.select("list", "parts")), "list")  # one row a list, 4,096 at most
    return index.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts"), sizes, centres


def _probe(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(q, id, dist): the k nearest of each list part to the queries (q, v, list, part) sent to it."""
    kinds = {f.name: f.dataType.simpleString() for f in [*index.schema, *asked.schema]}

    def compare(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(queries):
            ids, v = own["id"].to_numpy(), np.stack(own["v"].to_numpy())
            for at in range(0, len(queries), 1024):
                some = queries.iloc[at : at + 1024]
                q, x = some["q"].to_numpy(), np.stack(some["v"].to_numpy())
                d = _distances(x, v)
                d[q[:, None] == ids] = np.inf  # not itself
                m = min(k, len(ids))
                best = np.argpartition(d, m - 1, axis=1)[:, : m + 8]  # a few more, as these distances are rounded
                exact = np.sqrt(((x[:, None] - v[best]) ** 2).sum(2))
                keep = np.isfinite(np.take_along_axis(d, best, 1))
                out.append(pd.DataFrame({"q": np.repeat(q, best.shape[1])[keep.ravel()], "id": ids[best].ravel()[keep.ravel()], "dist": exact.ravel()[keep.ravel()]}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "id": [], "dist": []})

    both = index.select("list", "part", "id", "v").groupBy("list", "part").cogroup(asked.groupBy("list", "part"))
    return both.applyInPandas(compare, f"q {kinds['q']}, id {kinds['id']}, dist double")


def nearest(index: DataFrame, sizes: DataFrame, centres: np.ndarray, asked: DataFrame, k: int, probes: int = 2) -> tuple[DataFrame, DataFrame]:
    """(q, v) -> (q, id, dist) of the k nearest other vectors, exactly, and (q, list) of the lists compared.

    First the `probes` lists with the nearest centroids; then those others whose centroid lies nearer than their radius
    and the k-th distance so far: by the triangle inequality no other list can hold a nearer vector.
    """

    def measure(batches):
        for b in batches:
            v = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, -1)
            if not len(v):
                continue
            d = _distances(v, centres)
            rank = np.empty_like(d, dtype=np.int64)
            np.put_along_axis(rank, d.argsort(1, kind="stable"), np.arange(d.shape[1])[None, :], 1)
            n, m = d.shape
            take = pa.array(np.repeat(np.arange(n), m))
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(np.tile(np.arange(m), n)), pa.array(d.ravel()), pa.array(rank.ravel())], names=["q", "list", "off", "rank"])

    asked = materialize(asked.where(F.size("v") > 0).select("q", F.col("v").cast("array<double>").alias("v")), "asked")
    kind = asked.schema["q"].dataType.simpleString()
    away = asked.mapInArrow(measure, f"q {kind}, list long, off double, rank long").join(F.broadcast(sizes), "list")
    away = materialize(away, "away")

    def sent(lists: DataFrame) -> DataFrame:
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
        return lists.select("q", "list", part).join(asked, "q").select("q", "v", "list", "part")

    first = away.where(F.col("rank") < probes)
    found = materialize(best_per_group(_probe(index, sent(first), k), ["q"], F.col("dist"), F.col("id"), n=k), "found")
    worst = found.groupBy(F.col("q").alias("f")).agg(F.count(F.lit(1)).alias("c"), F.max("dist").alias("far"))
    more = away.where(F.col("rank") >= probes).join(worst, F.col("q") == F.col("f"), "left")
    slack = 1e-9  # distances to centroids are rounded
    more = more.where(F.coalesce(F.col("c") < k, F.lit(True)) | (F.col("off") - F.col("radius") <= F.col("far") * (1 + slack) + slack))
    more = materialize(more.select("q", "list", "parts"), "more")
    rest = _probe(index, sent(more), k)
    out = best_per_group(found.unionByName(rest), ["q"], F.col("dist"), F.col("id"), n=k)
    return out, first.select("q", "list").unionByName(more.select("q", "list"))
