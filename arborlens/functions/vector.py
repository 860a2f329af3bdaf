"""Vector arithmetic on array<double> columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def similar_to(rows: DataFrame, query: DataFrame, v: str = "v", by: str = "cosine") -> DataFrame:
    """rows with `similarity` to each vector `q` of query, a stated set of queries (its size decides how Spark joins it)."""
    f = cosine if by == "cosine" else dot
    return rows.crossJoin(query).withColumn("similarity", f(F.col(v), F.col("q")))


def from_object(column: Column, names: list[str]) -> Column:
    """The values of a map under all names, in their order; null if any is missing."""
    values = F.array(*[F.try_element_at(column, F.lit(n)) for n in names])
    return F.when(F.forall(values, lambda x: x.isNotNull()), values)
