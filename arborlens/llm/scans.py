"""Running numbers and running XORs inside groups, over rows that are sorted by range, so that a group of any size is
parted among tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlens.llm.runs import key_starts
from arborlens.llm.work import materialize


def running(rows: DataFrame, group: str, order: list[str], number: str, xors: tuple[str, ...] = ()) -> DataFrame:
    """rows with `number`, 1 for the first of its group by `order`, and with each long column of xors replaced by the XOR of
    it over the rows of the group up to this one. group is a long without nulls.

    Tasks scan their range; of groups that reach over several ranges only one row a range meets again, for what lies in
    the ranges before it.
    """
    columns = rows.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + f", {number} long, _part long"
    parted = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, n, held = None, 0, [0] * len(xors)
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(group).to_numpy()
            starts = key_starts([g])
            begin = np.zeros(len(g), np.int64)
            begin[starts] = starts
            begin = np.maximum.accumulate(begin)
            count = np.arange(len(g)) - begin + 1
            goes_on = int(starts[1]) if len(starts) > 1 else len(g)
            goes_on = goes_on if last is not None and g[0] == last else 0
            count[:goes_on] += n
            scanned = {}
            for k, c in enumerate(xors):
                v = np.bitwise_xor.accumulate(b.column(c).to_numpy())
                v = v ^ np.where(begin > 0, v[begin - 1], 0)
                v[:goes_on] ^= held[k]
                scanned[c] = pa.array(v)
                held[k] = v[-1]
            last, n = g[-1], count[-1]
            out = [scanned.get(c, b.column(c)) for c in columns] + [pa.array(count), pa.array(np.full(len(g), part))]
            yield pa.RecordBatch.from_arrays(out, names=[*columns, number, "_part"])

    done = materialize(parted.mapInArrow(kernel, schema), "scanned")
    ends = done.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.max(number).alias("_n"), *[F.max_by(c, number).alias(f"_x{k}") for k, c in enumerate(xors)])
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_g", "_p", F.sum("_n").over(before).alias("_n"), *[F.bit_xor(f"_x{k}").over(before).alias(f"_x{k}") for k in range(len(xors))])
    ends = materialize(ends.where(F.col("_n").isNotNull()), "offsets")  # at most one group a range goes on in it
    out = done.join(ends, (F.col(group) == F.col("_g")) & (F.col("_part") == F.col("_p")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    shifted = {c: F.col(c).bitwiseXOR(zero(F.col(f"_x{k}"))).alias(c) for k, c in enumerate(xors)}
    return out.select(*[shifted.get(c, F.col(c)) for c in columns], (F.col(number) + zero(F.col("_n"))).alias(number))
