"""A ledger whose charges are refused when the balance does not cover them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(moves: DataFrame, owner: str, amount: str, key: str, *order: str) -> DataFrame:
    """(owner, key, amount, accepted, balance): moves of each owner in order; a move that would take the balance below
    zero is refused, so acceptance depends on what was accepted before and no running sum can say it. A move key counts
    once, its first time. Owners stream through sorted partitions in constant memory."""
    first = F.min_by(F.struct(owner, amount, *[o for o in order if o != key]), F.struct(*order))
    rows = moves.groupBy(key).agg(first.alias("_m")).select(key, "_m.*")
    rows = rows.select(F.col(owner).cast("long").alias("owner"), F.col(key).cast("long").alias("key"), F.col(amount).cast("long").alias("amount"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])
    rows = rows.repartition("owner").sortWithinPartitions("owner", *[f"_o{i}" for i in range(len(order))]).select("owner", "key", "amount")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, balance = object(), 0
        for b in batches:
            ok, left = [], []
            for o, a in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if o != now:
                    now, balance = o, 0
                ok.append(balance + a >= 0)
                balance += a if ok[-1] else 0
                left.append(balance)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ok, pa.bool_()), pa.array(left, pa.int64())], names=["owner", "key", "amount", "accepted", "balance"])

    return rows.mapInArrow(kernel, "owner long, key long, amount long, accepted boolean, balance long")
