"""Filters, joins and write rules that the reference queries are made of, as functions of DataFrames and columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlens.workspace import materialize


def optional(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """A range filter whose bounds count only where they are given, so that an absent one leaves no predicate behind."""
    if low is not None:
        df = df.where(F.col(column) >= low)
    return df if high is None else df.where(F.col(column) <= high)


def like_any(column: Column, patterns: Sequence[str], ignore_case: bool = False) -> Column:
    """Whether any pattern matches; wildcards in the patterns keep their meaning. Without patterns: false."""
    out = F.lit(False)
    for p in patterns:
        out = out | (column.ilike(p) if ignore_case else column.like(p))
    return out


def not_like_all(column: Column, patterns: Sequence[str]) -> Column:
    """Null, or matched by none of the patterns."""
    return column.isNull() | ~like_any(column, patterns)


def meaningful(column: Column) -> Column:
    """The value unless it is one of the three encodings of a missing one: null, empty, 'NA'."""
    return F.nullif(F.nullif(F.trim(column), F.lit("")), F.lit("NA"))


def best_per_group(df: DataFrame, keys: Sequence[str], *order: Column, n: int = 1) -> DataFrame:
    """The first n rows of each group; Spark cuts groups down before the shuffle (WindowGroupLimit)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def pick_per_group(df: DataFrame, keys: Sequence[str], order: Column, *columns: str) -> DataFrame:
    """One row a group, that with the least order, by an aggregate that combines before the shuffle: no sort, and a
    group with any share of the rows costs one row a task."""
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("_row"))
    return picked.select(*keys, "_row.*")


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def page(df: DataFrame, number: int, size: int, *order: Column, most: int = 500) -> DataFrame:
    """Page `number` from 1, its size clamped to 1..most."""
    size = min(max(size, 1), most)
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def upsert_last_wins(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace old ones with their keys. An anti join: only keys of the new side are shuffled against the old."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def upsert_with(old: DataFrame, new: DataFrame, keys: Sequence[str], rules: dict[str, str]) -> DataFrame:
    """Full join of old and new on keys; rules name what a conflict does to a column: 'new', 'old' (kept unless null),
    'greatest', 'concat' (arrays, appended without removing repeats; an empty or null new one keeps the old)."""
    o = old.select(*keys, F.struct(*rules).alias("_o"))
    n = new.select(*keys, F.struct(*rules).alias("_n"))
    both = o.join(n, list(keys), "full")
    out = {}
    for c, rule in rules.items():
        a, b = F.col(f"_o.{c}"), F.col(f"_n.{c}")
        if rule == "new":
            out[c] = F.when(F.col("_n").isNotNull(), b).otherwise(a)
        elif rule == "old":
            out[c] = F.coalesce(a, b)
        elif rule == "greatest":
            out[c] = F.greatest(a, b)
        elif rule == "concat":
            out[c] = F.when(a.isNull(), b).when(b.isNull() | (F.size(b) == 0), a).otherwise(F.concat(a, b))
        else:
            raise ValueError(rule)
    return both.select(*keys, *[v.alias(k) for k, v in out.items()])


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"))


def update_from(df: DataFrame, source: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """df with column taken from source where source has a row with the keys (one at most), whatever its value."""
    s = source.select(*keys, F.struct(column).alias("_s"))
    value = F.when(F.col("_s").isNotNull(), F.col(f"_s.{column}")).otherwise(F.col(column))
    return df.join(s, list(keys), "left").withColumn(column, value).drop("_s")


def explode_map(df: DataFrame, column: str, key: str = "taxon", value: str = "n") -> DataFrame:
    """A row a map entry: turns tests for a key into equality joins."""
    return df.select(*[c for c in df.columns if c != column], F.explode(column).alias(key, value))


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: str = "s1", exclude: DataFrame | None = None) -> DataFrame:
    """n rows of each stratum in the order of a seeded hash of their key: reruns agree, at any partitioning."""
    if exclude is not None:
        df = df.join(exclude.select(key), key, "left_anti")
    return best_per_group(df, [stratum], F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), F.col(key), n=n)


def ranked(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """rows with their 0-based place in a total order, without a single-task sort: places within range partitions plus
    the sizes of the partitions before (as many rows as there are partitions)."""
    rows = materialize(rows, "unranked")  # read twice: for the ranges' bounds and for the sort
    parts = rows.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    parts = materialize(parts, "ranked")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
    return parts.join(sizes, "_part").withColumn(name, F.col("_before") + within - 1).drop("_part", "_at", "_before")


def percentile_place(df: DataFrame, score: str, tie: str, keys: Sequence[str] = ()) -> DataFrame:
    """`place` 0..100 of each row by ascending score, ties in the order of `tie`: i / (n - 1), 100 for a single row,
    to one decimal, halves up. Over the whole table the order is found partition by partition."""
    if keys:
        w = Window.partitionBy(*keys)
        df = df.withColumns({"_i": F.row_number().over(w.orderBy(score, tie)) - 1, "_n": F.count(F.lit(1)).over(w)})
    else:
        df = ranked(df, F.col(score), F.col(tie), name="_i")
        df = df.crossJoin(df.agg(F.count(F.lit(1)).alias("_n")))
    value = F.when(F.col("_n") == 1, F.lit(100.0)).otherwise(F.col("_i") * 100.0 / (F.col("_n") - 1))
    return df.withColumn("place", F.floor(value * 10 + 0.5) / 10).drop("_i", "_n")


def tier(score: Column) -> Column:
    return F.when(score >= 90, "BEST").when(score >= 70, "GOOD").when(score >= 50, "ACCEPTABLE").otherwise("LOW")


def match_quality(similarity: Column) -> Column:
    s = similarity
    return F.when(s >= 0.9, "excellent").when(s >= 0.8, "good").when(s >= 0.7, "moderate").when(s >= 0.6, "marginal").otherwise("poor")


def native_status(native: Column, introduced: Column, patterns: Sequence[str], invasive: Column | None = None) -> Column:
    """invasive before native_and_introduced, native, introduced, unknown: whether a list mentions any pattern, as a
    part of a word too, ignoring case."""
    mentions = lambda c: F.coalesce(F.exists(F.array(*[F.lit(p.lower()) for p in patterns]), lambda p: F.contains(F.lower(c), p)), F.lit(False))
    n, i = mentions(native), mentions(introduced)
    status = F.when(n & i, "native_and_introduced").when(n, "native").when(i, "introduced").otherwise("unknown")
    return status if invasive is None else F.when(invasive, "invasive").otherwise(status)


def price_in_credits(hectares: Column) -> Column:
    """Piecewise linear in the area, rounded up."""
    h = hectares
    cost = (
        F.when(h <= 5, F.lit(10.0)).when(h <= 10, F.lit(10.0)).when(h <= 100, 10 + (h - 10) * 0.5)
        .when(h <= 1000, 55 + (h - 100) * 0.2).when(h <= 10000, 235 + (h - 1000) * 0.05).otherwise(685 + (h - 10000) * 0.02)
    )
    return F.ceil(F.round(cost, 6)).cast("long")
