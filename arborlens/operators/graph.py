"""Basic graph patterns over a table of quads, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pattern(quads: DataFrame, predicate: str | Column, subject: str, obj: str) -> DataFrame:
    """Bindings (subject, obj) of one triple pattern; a text predicate is a filter that reaches the scan."""
    hit = F.col("predicate") == predicate if isinstance(predicate, str) else predicate
    return quads.where(hit).select(F.col("subject").alias(subject), F.col("object").alias(obj))


def literal(term: Column) -> Column:
    """The text of a quoted term, the address of a bracketed one."""
    return F.when(term.startswith('"'), F.replace(F.substring(term, F.lit(2), F.char_length(term) - 2), F.lit('\\"'), F.lit('"'))).otherwise(F.regexp_replace(term, "^<|>$", ""))
