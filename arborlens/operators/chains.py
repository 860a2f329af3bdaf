"""Chains of digests: each covers the one before, so that one altered record shows in it and in all that follow."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the first record of a chain covers in place of a digest before it.
START = "0" * 64


def content_digest(*columns: Column) -> Column:
    """SHA-256 of columns as one JSON array, nulls included, so that no two rows of values read alike."""
    return F.sha2(F.to_json(F.array(*[c.cast("string") for c in columns]), {"ignoreNullFields": "false"}), 256)


def chained(records: DataFrame, key: str, order: Sequence[str], content: str, name: str = "digest") -> DataFrame:
    """records with `name`, the SHA-256 of the digest before it and its own content digest, in the order of each key (null
    keys form a chain), and `previous`, the digest that it covers.

    Contents are hashed before; here only digests stream by, sorted by key, with one digest as the state, so a chain of
    any length takes constant memory. A chain cannot be parted: each digest needs the one before.
    """
    columns = records.columns
    rows = records.repartition(key).sortWithinPartitions(key, *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", previous string, {name} string"
    at_key, at_content = columns.index(key), columns.index(content)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = object(), START
        for b in batches:
            before, own = [], []
            for k, text in zip(b.column(at_key).to_pylist(), b.column(at_content).to_pylist(), strict=True):
                if k != now:
                    now, digest = k, START
                before.append(digest)
                digest = hashlib.sha256(f"{digest}:{'' if text is None else text}".encode()).hexdigest()
                own.append(digest)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before, pa.string()), pa.array(own, pa.string())], names=[*columns, "previous", name])

    return rows.mapInArrow(kernel, schema)


def verified(archived: DataFrame, found: DataFrame, key: str, order: Sequence[str], ids: Sequence[str], content: str) -> DataFrame:
    """The ids and key of archived records (with their digest) and `state` against the chain over what is found now: ok;
    altered where the record's own content differs; broken where an earlier one of its chain differs or is gone; missing
    where it is gone itself. found holds key, order, ids and content."""
    now = chained(found, key, order, content, "_digest").select(*[F.col(c).alias(f"_{c}") for c in ids], F.col(content).alias("_content"), "_digest")
    same = F.lit(True)
    for c in ids:
        same = same & (F.col(c) == F.col(f"_{c}"))
    state = F.when(F.col("_digest").isNull(), "missing").when(~F.col("_content").eqNullSafe(F.col(content)), "altered").when(F.col("_digest") != F.col("digest"), "broken").otherwise("ok")
    return archived.join(now, same, "left").select(*ids, key, state.alias("state"))
