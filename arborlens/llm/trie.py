"""The prefix trie of conversations: what each shared beginning saves, how it branches, and who ends there.

A prefix of d turns is named by 128 bits: the XOR of two hashes of (depth, turn) over its turns, so that the name of the
prefix before it is one XOR away. Node tables are minimal perfect hashes over these names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.llm.runs import key_starts, whole_runs
from arborlens.llm.scans import running
from arborlens.llm.work import materialize


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> conv_id, place (1, 2, ...), t1, t2 (128 bits of role and text) and size (code points).

    A null turn comes first; rows with one turn follow role, then t1 and t2; null roles and texts are empty; equal rows are
    turns of their own; rows without conv_id belong to no conversation. No text is shuffled.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")]
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said[0].alias("role"),
        F.xxhash64(*said).alias("t1"), F.xxhash64(F.lit(1), *said).alias("t2"), F.char_length(said[1]).cast("long").alias("size"),
    )
    return running(rows, "conv_id", ["turn", "role", "t1", "t2"], "place").select("conv_id", "place", "t1", "t2", "size")


def paths(numbered: DataFrame) -> DataFrame:
    """conv_id, depth, t1, t2, size, full: every conversation as it is, with a row of depth 0 for its beginning."""
    convs = numbered.groupBy(F.col("conv_id").alias("c")).agg(F.max("place").alias("full"))
    rows = numbered.join(convs, F.col("conv_id") == F.col("c")).select("conv_id", F.col("place").alias("depth"), "t1", "t2", "size", "full")
    return rows.unionByName(_beginnings(convs.withColumnRenamed("c", "conv_id")))


def _beginnings(convs: DataFrame) -> DataFrame:
    none = F.lit(0).cast("long")
    return convs.select("conv_id", none.alias("depth"), none.alias("t1"), none.alias("t2"), none.alias("size"), "full")


def with_shared_openings(numbered: DataFrame, family: int = 100, most: int = 6) -> DataFrame:
    """paths() of conversations whose first h turns are those of their family's first conversation c - c % family (all it
    has, if fewer; none, if there is none), h = crc32(c) % most; their own turns after the first h follow."""
    rows = materialize(numbered, "numbered")
    c = F.col("conv_id")
    convs = rows.groupBy("conv_id").agg(F.max("place").alias("n")).withColumns({"base": c - c % family, "h": F.crc32(c.cast("string").cast("binary")) % most})
    convs = materialize(convs, "conversations")
    # a family has at most `family` members and its opening `most` turns, so neither join grows with a key
    bases = convs.select(F.col("conv_id").alias("b"), F.col("n").alias("base_n"))
    convs = convs.join(bases, F.col("base") == F.col("b"), "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("full"))
    convs = materialize(convs, "rebuilt")
    mine = convs.select(c.alias("k"), "h", "taken", "full")
    own = rows.join(mine, c == F.col("k")).where(F.col("place") > F.col("h"))
    own = own.select("conv_id", (F.col("taken") + F.col("place") - F.col("h")).alias("depth"), "t1", "t2", "size", "full")
    first = rows.where((F.col("place") < most) & (c % family == 0)).withColumnRenamed("conv_id", "b")
    first = first.join(convs, (F.col("b") == F.col("base")) & (F.col("place") <= F.col("h")))
    first = first.select("conv_id", F.col("place").alias("depth"), "t1", "t2", "size", "full")
    return own.unionByName(first).unionByName(_beginnings(convs.select("conv_id", "full")))


class NodeTable:
    """A minimal perfect hash of distinct 128-bit names: n names, slots 0 to n - 1.

    Each level throws the names that are left into twice as many cells; those alone in a cell get the cell's rank as their
    slot, the others go on to the next level. Each slot keeps its name, so a look-up is verified and a name that is not in
    the table has slot -1.
    """

    def __init__(self, k1: np.ndarray, k2: np.ndarray):
        left, base, self.levels = np.arange(len(k1)), 0, []
        self.slots = np.empty(len(k1), np.int64)
        while len(left):
            if len(self.levels) == 64:
                raise ValueError("equal names in a node table")
            cells = 2 * len(left)
            at = self._cell(k1[left], k2[left], len(self.levels), cells)
            alone = np.bincount(at, minlength=cells) == 1
            rank = np.cumsum(alone) - 1 + base
            placed = alone[at]
            self.slots[left[placed]] = rank[at[placed]]
            self.levels.append((cells, alone, rank))
            base += int(placed.sum())
            left = left[~placed]
        self.k1, self.k2 = np.empty_like(k1), np.empty_like(k2)
        self.k1[self.slots], self.k2[self.slots] = k1, k2
        if not (np.array_equal(self.k1[self.slots], k1) and np.array_equal(self.k2[self.slots], k2)):
            raise ValueError("two names in one slot")

    @staticmethod
    def _cell(k1: np.ndarray, k2: np.ndarray, level: int, cells: int) -> np.ndarray:
        x = k1.view(np.uint64) ^ (k2.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level * 0xD1B54A32D192ED03 % (1 << 64)))
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return ((x ^ (x >> np.uint64(33))) % np.uint64(cells)).astype(np.int64)

    def find(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        out, left = np.full(len(k1), -1, np.int64), np.arange(len(k1))
        for level, (cells, alone, rank) in enumerate(self.levels):
            at = self._cell(k1[left], k2[left], level, cells)
            hit = alone[at]
            slot = rank[at[hit]]
            here = left[hit]
            same = (self.k1[slot] == k1[here]) & (self.k2[slot] == k2[here])
            out[here[same]] = slot[same]
            left = left[~hit]
        return out


_DONE = "k1 long, k2 long, p1 long, p2 long, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, parent_conv_id long, top boolean"


def _accumulate(nodes: DataFrame) -> DataFrame:
    """Nodes with key (their shard), names, own and seed values -> _DONE: children, leaves and saved tokens of each
    subtree as far as it lies in the node's shard, above the seeds that come from other shards. top: the parent is not in
    the shard. A task holds the whole shards of a batch, in flat arrays."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shards, _ in whole_runs(batches, ["key"]):
            c = {n: shards.column(n).to_numpy() for n in shards.column_names}
            table = NodeTable(c["k1"], c["k2"])
            n, slot = len(c["k1"]), table.slots

            def scattered(values: np.ndarray, slot=slot, n=n) -> np.ndarray:
                out = np.zeros(n, np.int64)
                out[slot] = values
                return out

            parent, key = scattered(table.find(c["p1"], c["p2"])), scattered(c["key"])
            parent[(parent >= 0) & (key[parent] != key)] = -1  # of another shard in this batch, which is summed up later
            depth, conv = scattered(c["depth"]), scattered(c["conv_id"])
            parent[depth == 0] = -1  # the root has no prefix before it
            children, leaves, saved = (scattered(c[f"seed_{x}"]) for x in ("children", "leaves", "saved"))
            saved += scattered((c["n_convs"] - 1) * c["size"])
            inside = parent >= 0
            np.add.at(children, parent[inside], 1)
            leaves[children == 0] += 1
            order = np.argsort(-depth, kind="stable")
            order = order[inside[order]]
            for level in np.split(order, key_starts([depth[order]])[1:]) if len(order) else ():
                np.add.at(leaves, parent[level], leaves[level])
                np.add.at(saved, parent[level], saved[level])
            own = parent[slot]
            out = [pa.array(c[x]) for x in ("k1", "k2", "p1", "p2", "conv_id", "depth", "n_convs")]
            out += [pa.array(x[slot]) for x in (children, leaves, saved)]
            out += [pa.array(conv[np.maximum(own, 0)], mask=own < 0), pa.array(own < 0)]
            yield pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in _DONE.split(", ")])

    rows = nodes.select("key", "k1", "k2", "p1", "p2", "conv_id", "depth", "n_convs", "size", "seed_children", "seed_leaves", "seed_saved")
    return materialize(rows.repartition("key").sortWithinPartitions("key").mapInArrow(kernel, _DONE), "subtrees")


def _seeds(nodes: DataFrame, *lower: DataFrame) -> DataFrame:
    """nodes with the sums of the subtrees below them that lie in other shards."""
    sums = None
    for done in lower:
        up = done.where("top and depth > 0").select("p1", "p2", "n_leaves", "saved_tokens")
        sums = up if sums is None else sums.unionByName(up)
    sums = sums.groupBy(F.col("p1").alias("s1"), F.col("p2").alias("s2")).agg(
        F.count(F.lit(1)).alias("seed_children"), F.sum("n_leaves").alias("seed_leaves"), F.sum("saved_tokens").alias("seed_saved")
    )
    out = nodes.join(sums, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")), "left").drop("s1", "s2")
    return out.na.fill(0, ["seed_children", "seed_leaves", "seed_saved"])


def _ends(steps: DataFrame, chunk: int = 1 << 12) -> DataFrame:
    """(e1, e2, ends_sha256) of the prefixes at which conversations end: their conv_ids are sorted by range and joined to text
    in parts of at most `chunk` ids; only such parts meet at one prefix, and are hashed as they stream by."""
    rows = steps.where("depth = full").select("k1", "k2", "conv_id").repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2, conv = (x.to_numpy() for x in b.columns)
            starts = key_starts([k1, k2])
            starts = np.union1d(starts, np.arange(0, len(k1), chunk)) if len(starts) else starts
            texts = [",".join(map(str, x.tolist())) for x in np.split(conv, starts[1:])] if len(starts) else []
            yield pa.RecordBatch.from_arrays([pa.array(x[starts]) for x in (k1, k2, conv)] + [pa.array(texts, pa.string())], names=["e1", "e2", "first", "ids"])

    joined = rows.mapInArrow(parts, "e1 long, e2 long, first long, ids string").repartition("e1", "e2").sortWithinPartitions("e1", "e2", "first")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        kinds = (pa.int64(), pa.int64(), pa.string())

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["e1", "e2", "ends_sha256"])

        for b in batches:
            out = []
            for e1, e2, _, ids in zip(*[x.to_pylist() for x in b.columns], strict=True):
                if now == (e1, e2):
                    held.update(b"," + ids.encode())
                    continue
                if held is not None:
                    out.append((*now, held.hexdigest()))
                now, held = (e1, e2), hashlib.sha256(ids.encode())
            yield pack(out)
        if held is not None:
            yield pack([(*now, held.hexdigest())])

    return joined.mapInArrow(digests, "e1 long, e2 long, ends_sha256 string")


def prefix_trie(walks: DataFrame) -> DataFrame:
    """paths() of conversations -> a row for each distinct prefix: conv_id (its smallest conversation; with depth it names the
    prefix's texts), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over its subtree, each prefix's
    conversations but one times the size of its last text) and ends_sha256 (of the conversations that end here). No
    conversation, no row.

    Names and counts of prefixes come from one aggregate. Subtrees are then summed up inside shards, each a node table with
    flat arrays and parent slots, deepest first: chains that only one conversation walks, in pieces; then subtrees whose
    walks count at most the square root of all rows; then the tree above them, whose nodes number at most that root at
    each depth. Each pass seeds the next one with sums, so a beginning that a third of all conversations share,
    however it branches, never meets in one task.
    """
    none = F.lit(0).cast("long")
    at = F.col("depth") > 0
    walks = walks.withColumns({"g1": F.when(at, F.xxhash64("depth", "t1", "t2")).otherwise(none), "g2": F.when(at, F.xxhash64(F.lit(2), "depth", "t1", "t2")).otherwise(none)})
    walks = walks.select("conv_id", "depth", "size", "full", "g1", "g2", F.col("g1").alias("k1"), F.col("g2").alias("k2"))
    steps = running(walks, "conv_id", ["depth"], "step", ("k1", "k2"))
    steps = steps.select("conv_id", "depth", "size", "full", "k1", "k2", F.col("k1").bitwiseXOR(F.col("g1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("g2")).alias("p2"))
    steps = materialize(steps, "steps")
    nodes = steps.groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.min("size").alias("size"), F.min("p1").alias("p1"),
        F.min("p2").alias("p2"), F.sum(F.col("full") - F.col("depth") + 1).alias("weight"), F.max("full").alias("full"),
    )
    nodes = materialize(nodes, "nodes")
    most = max(64, math.isqrt(steps.count()))
    lone, heavy = F.col("n_convs") == 1, (F.col("weight") > most) | (F.col("depth") == 0)

    # chains: a piece of `most` nodes is a shard; where a chain goes on, one leaf lies below
    goes_on = (lone & (F.col("depth") < F.col("full")) & ((F.col("depth") + 1) % most == 0)).cast("long")
    seeds = {"seed_children": goes_on, "seed_leaves": goes_on, "seed_saved": none}
    chains = nodes.where(lone & at).withColumns({"key": F.xxhash64("conv_id", F.floor(F.col("depth") / most)), **seeds})
    chains = _accumulate(chains)

    # subtrees below the heavy nodes, which are the first ones of any path: the shard is the first node that is not heavy
    upper = materialize(nodes.where(heavy & (~lone | ~at)), "upper")
    tops = upper.where(at).select(F.col("k1").alias("h1"), F.col("k2").alias("h2"))
    deep = steps.where(at).join(tops, (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")), "left_semi").groupBy(F.col("conv_id").alias("c")).agg((F.count(F.lit(1)) + 1).alias("from"))
    owners = nodes.where(~lone & ~heavy).select(F.col("conv_id").alias("o")).distinct()
    first = steps.join(owners, F.col("conv_id") == F.col("o"), "left_semi").join(deep, F.col("conv_id") == F.col("c"), "left")
    first = first.where(F.col("depth") == F.coalesce("from", F.lit(1))).select(F.col("conv_id").alias("o"), F.xxhash64("k1", "k2").alias("key"))
    light = nodes.where(~lone & ~heavy).join(first, F.col("conv_id") == F.col("o")).drop("o")
    light = _accumulate(_seeds(light, chains))

    upper = _accumulate(_seeds(upper.withColumn("key", none), chains, light))
    done = chains.unionByName(light).unionByName(upper)
    # nodes whose parent lies in another shard still need its conversation
    known = nodes.select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("conv_id").alias("parent"))
    cut = done.where("top and depth > 0").join(known, (F.col("p1") == F.col("n1")) & (F.col("p2") == F.col("n2")))
    cut = cut.withColumn("parent_conv_id", F.col("parent")).drop("n1", "n2", "parent")
    done = done.where("not top or depth = 0").unionByName(cut)
    ends = _ends(steps)
    out = done.join(ends, (F.col("k1") == F.col("e1")) & (F.col("k2") == F.col("e2")), "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
