"""Streaming over a partition that is sorted by a key: whole runs of equal keys, without holding the partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def key_starts(keys: list[np.ndarray]) -> np.ndarray:
    """First row of each run of equal keys in rows sorted by them."""
    n = len(keys[0])
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables made of whole runs, with the first row of each run. Holds one batch and one unfinished run."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        part = pa.Table.from_batches([*rest, batch]).combine_chunks()
        starts = key_starts([part.column(k).to_numpy() for k in keys])
        cut = int(starts[-1])
        if cut:
            yield part.slice(0, cut), starts[:-1]
        rest = part.slice(cut).to_batches()
    if rest:
        part = pa.Table.from_batches(rest).combine_chunks()
        yield part, key_starts([part.column(k).to_numpy() for k in keys])


def min_labels(n: int, left: np.ndarray, right: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest member index of each of n nodes' components under the links left-right; label carries earlier links,
    as this function returned it. Only roots are hooked, to lower roots, so no earlier link is lost."""
    label = np.arange(n) if label is None else label
    while True:
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            return label
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label[label], label):
            label = label[label]
