"""Near-duplicate embeddings: sign hashing by random hyperplanes, exact cosine, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.llm.components import connected_components
from arborlens.llm.runs import min_labels, whole_runs
from arborlens.llm.work import materialize

SEED = 20240229


def sign_codes(vectors: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """(rows x tables) int32: which side of `bits` seeded hyperplanes each vector lies on."""
    planes = np.random.default_rng(SEED).standard_normal((vectors.shape[1], tables * bits))
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return (signs @ (1 << np.arange(bits))).astype(np.int32)


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows times the power of two that takes their largest component to 0.5 or more, so that no square overflows or vanishes."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def plan(largest: int, threshold: float, bucket: int = 512, miss: float = 1e-3) -> tuple[int, int]:
    """(bits, tables): so many bits that a bucket of the largest label holds about `bucket` vectors, and so many tables
    that a pair right at the threshold shares none with a probability below `miss`."""
    bits = max(4, math.ceil(math.log2(max(1, largest) / bucket)))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - same))


def _near_rows(v: np.ndarray, norm: np.ndarray, cut: int, same: bool, threshold: float, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs i < j with a cosine of at least threshold: all pairs where `same`, else those across `cut`. Blocks of a
    matrix product find the candidates, and their cosines are then computed pair by pair."""
    n = len(v)
    for s in range(0, n if same else cut, step):
        e = min(s + step, n if same else cut)
        for t in range(s if same else cut, n, step):
            u = min(t + step, n)
            i, j = np.nonzero(v[s:e] @ v[t:u].T >= (threshold - 1e-9) * norm[s:e, None] * norm[t:u])
            i, j = i + s, j + t
            ahead = i < j
            i, j = i[ahead], j[ahead]
            for k in range(0, len(i), 100_000):
                a, b = i[k : k + 100_000], j[k : k + 100_000]
                near = np.einsum("ij,ij->i", v[a], v[b]) / (norm[a] * norm[b]) >= threshold
                yield a[near], b[near]


def cosine_links(vectors: DataFrame, threshold: float, tables: int, bits: int, tile: int) -> DataFrame:
    """(id, label, v, weight) distinct vectors -> (id, root, n): links of a forest and, at root = id, the weight linked.

    A bucket is a label, a dimension, a table and a code. One with more than `tile` vectors is split into parts whose
    pairs are compared as groups of their own, so no task holds more than two parts. A pair that shares several buckets
    counts only in its first table. Groups return at most one link and one count a vector.
    """
    kind = vectors.schema["v"].dataType.simpleString()
    exact = pa.list_(pa.float32() if kind == "array<float>" else pa.float64())

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            out = np.empty(b.num_rows, dtype=object)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                v = np.stack([np.asarray(lists[k].values) for k in at.tolist()]).astype(np.float64)
                codes = sign_codes(_scaled(v), tables, bits)
                for k, code in zip(at.tolist(), codes, strict=True):
                    out[k] = code
            codes = pa.array(list(out), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], lists.cast(exact), b.column(3), codes], names=["id", "label", "v", "weight", "codes"])

    kinds = vectors.schema
    head = f"id {kinds['id'].dataType.simpleString()}, label {kinds['label'].dataType.simpleString()}"
    reps = materialize(vectors.mapInArrow(coded, f"{head}, v {kind}, weight long, codes array<int>"), "coded")
    keys = ["label", "dim", "t", "code"]
    places = reps.select("label", F.size("v").alias("dim"), F.posexplode("codes").alias("t", "code"))
    large = places.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile)
    large = materialize(large.select(*keys, F.ceil(F.col("n") / tile).cast("int").alias("parts")), "large")
    rows = reps.select("id", "label", F.size("v").alias("dim"), "v", "weight", "codes", F.posexplode("codes").alias("t", "code"))
    rows = rows.join(large, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("p", F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int"))
    rows = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumns({"p1": F.least("p", "q"), "p2": F.greatest("p", "q"), "side": (F.col("p") > F.col("q")).cast("int")})
    group = [*keys, "p1", "p2"]
    rows = rows.select("id", "v", "weight", "codes", *group, "side")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_runs(batches, group):
            ids, side, table, dims, weight = (rows.column(c).to_numpy() for c in ("id", "side", "t", "dim", "weight"))
            p1, p2 = rows.column("p1").to_numpy(), rows.column("p2").to_numpy()
            codes = rows.column("codes").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            flat = rows.column("v").combine_chunks().flatten().to_numpy()
            at = np.concatenate(([0], np.cumsum(dims, dtype=np.int64)))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
                same = p1[s] == p2[s]
                cut = e - s if same else int(np.count_nonzero(side[s:e] == 0))
                if e - s < 2 or not cut or (not same and cut == e - s):
                    continue
                v = flat[at[s] : at[e]].reshape(e - s, -1).astype(np.float64)
                v = _scaled(v)
                norm = np.sqrt(np.einsum("ij,ij->i", v, v))
                label, linked, own = np.arange(e - s), np.zeros(e - s, np.int64), codes[s:e]
                for i, j in _near_rows(v, norm, cut, same, threshold):
                    first = np.argmax(own[i] == own[j], axis=1) == table[s]
                    i, j = i[first], j[first]
                    np.add.at(linked, i, weight[s + j])
                    np.add.at(linked, j, weight[s + i])
                    label = min_labels(e - s, i, j, label)
                some, joined = np.flatnonzero(linked), np.flatnonzero(label != np.arange(e - s))
                out.append((ids[s + some], ids[s + some], linked[some]))
                out.append((ids[s + joined], ids[s + label[joined]], np.zeros(len(joined), np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["id", "root", "n"])

    return rows.repartition(*group).sortWithinPartitions(*group, "side").mapInArrow(kernel, "id long, root long, n long")


def embedding_dedup(
    vectors: DataFrame, threshold: float = 0.93, tables: int | None = None, bits: int | None = None, tile: int = 4096,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row.

    Rows link when their labels are equal and not null and their cosine, in double precision, is at least threshold.
    Bits and tables follow from the largest label (plan()), so that buckets do not grow with the table: a pair at exactly
    the threshold shares no table with a probability below 0.1 %. Vectors
    that are null, empty, zero or hold a null or non-finite component link with nothing and form components of their
    own, as do rows without label; vectors of different lengths never link. Equal vectors of one label are one node
    with a weight, so that a group of copies of any size costs nothing. Rows with equal ids are separate rows that link.
    """
    v = F.col("v")
    # single precision is kept where the table holds it: half the bytes to shuffle, and exact in double precision
    kind = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast(kind).alias("v")
    )
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists(v, lambda x: x != 0)
    good = rows.where(usable)
    reps = good.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"))
    reps = materialize(reps.select("id", "label", "v", "weight"), "vectors")
    largest = reps.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    own_bits, own_tables = plan(largest, threshold)
    bits, tables = bits or own_bits, tables or own_tables
    found = materialize(cosine_links(reps, threshold, tables, bits, tile), "found")
    roots = connected_components(found.where("id != root").select(F.col("id").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    named = reps.join(counts, "id", "left").join(roots, F.col("id") == F.col("node"), "left")
    named = named.select(
        F.col("label").alias("l"), F.col("v").alias("w"), F.coalesce("root", "id").alias("component_id"),
        (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
    )
    named = materialize(named, "named")
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    linked = rows.where("ok").join(named, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")))
    out = linked.select("vec_id", "n_links", "component_id").unionByName(
        rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
