"""SimHash near-duplicates: whole-text fingerprints, an exact tiled comparison, and components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlens.llm.components import connected_components
from arborlens.llm.runs import min_labels, whole_runs
from arborlens.llm.work import fresh, marked, materialize

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)
_LANES = 256 * np.arange(8)
_ODD, _ADD = np.random.default_rng(20240301).integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """The hashes themselves for word 0, else an independent-looking bijection of them (splitmix64 finaliser)."""
    if word == 0:
        return h
    z = h + np.uint64((0x9E3779B97F4A7C15 * word) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the text's word shingles in their order; a shorter text is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII space count
    if not words:
        return np.zeros(0, "<u8")
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[s:e], 42) for s, e in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype="<u8")


def simhash(hashes: np.ndarray, width: int) -> list[int]:
    """Majority of each bit of the hashes, as `width` signed 64-bit words; zeros for none."""
    if not len(hashes):
        return [0] * width
    out = []
    for word in range(width):
        octets = _mixed(hashes, word).view(np.uint8).reshape(-1, 8) + _LANES
        ones = np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BITS
        out.append(int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0]))
    return out


def fingerprint(text: str | None, shingle: int = 3, width: int = 1) -> list[int]:
    """SimHash of the text's word shingles as `width` signed 64-bit words; zeros for a text without words."""
    return simhash(shingle_hashes(text, shingle), width)


def fingerprints(docs: DataFrame, shingle: int = 3, width: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp array of `width` longs) per row, in one pass without a shuffle."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle, width) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.list_(pa.int64()))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(kernel, "doc_id long, fp array<long>")


def _quarters(fp: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit quarters of the first word."""
    return np.bitwise_count(np.ascontiguousarray(fp[:, 0]).view(np.uint16).reshape(-1, 4)).astype(np.int16)


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) with at most radius differing bits between uint64 tiles a and b (rows x words), block by block.

    Both tiles are sorted by their quarters' population counts; blocks whose ranges of those counts lie more than
    radius apart in sum hold no such pair and are skipped.
    """
    qa, qb = _quarters(a), _quarters(b)
    oa, ob = np.lexsort(qa.T[::-1]), np.lexsort(qb.T[::-1])
    a, b, qa, qb = a[oa].T.copy(), b[ob].T.copy(), qa[oa], qb[ob]
    at = np.arange(0, b.shape[1], block)
    low, high = np.minimum.reduceat(qb, at), np.maximum.reduceat(qb, at)
    whole = max(1, len(a) - 1)  # words that are compared for every pair; the last only for those still near
    for s in range(0, a.shape[1], block):
        part, q = a[:, s : s + block], qa[s : s + block]
        apart = np.maximum(0, np.maximum(low - q.max(0), q.min(0) - high)).sum(1)
        for t in at[apart <= radius].tolist():
            other = b[:, t : t + block]
            bits = np.bitwise_count(part[0][:, None] ^ other[0])
            for w in range(1, whole):
                bits += np.bitwise_count(part[w][:, None] ^ other[w])
            near = bits <= radius
            if not near.any():
                continue
            i, j = np.nonzero(near)
            if whole < len(a):
                close = bits[i, j] + np.bitwise_count(part[-1][i] ^ other[-1][j]) <= radius
                i, j = i[close], j[close]
            if len(i):
                yield oa[s + i], ob[t + j]


def tile_links(fps: DataFrame, radius: int = 3, tile: int | None = None) -> DataFrame:
    """Distinct (node long, fp) -> links (u, v) of nodes that join exactly those within radius, transitively.

    Without `tile` it is 8,192, and more from a million fingerprints on (with their square root, 65,536 at most), so that
    a fingerprint is sent to fewer tiles.

    A tile holds fingerprints whose first words have about equal population counts in both 32-bit halves, split by
    hash into parts of about `tile`; tile pairs whose counts differ by more than radius are never formed. Each pair of
    tiles is one task-sized group; it returns a forest (at most one link a node), never all pairs.
    """
    grain = 1 + radius // 4  # width of a range of population counts
    halves = [F.floor(F.bit_count(x) / grain).cast("int") for x in (F.shiftrightunsigned(F.col("fp")[0], 32), F.col("fp")[0].bitwiseAND(F.lit(0xFFFFFFFF)))]
    cells = materialize(fps.select("node", "fp", halves[0].alias("hi"), halves[1].alias("lo")), "fps")
    tile = tile or min(65536, max(8192, 8 * math.isqrt(cells.count())))
    sizes = materialize(cells.groupBy("hi", "lo").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("parts")), "cells")
    gap = lambda d: max(0, (abs(d) - 1) * grain + 1)  # noqa: E731  least difference of counts in ranges d apart
    reach = range(-radius, radius + 1)
    near = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in reach for y in reach if gap(x) + gap(y) <= radius]
    others = sizes.select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), F.col("parts").alias("parts2"))
    around = (  # for each cell the parts of its neighbours, itself included; at most 33 x 33 cells
        sizes.select("*", F.explode(F.array(*near)).alias("d"))
        .select("hi", "lo", "parts", (F.col("hi") + F.col("d.x")).alias("hi2"), (F.col("lo") + F.col("d.y")).alias("lo2"))
        .join(others, ["hi2", "lo2"])
        .groupBy("hi", "lo", "parts")
        .agg(F.collect_list(F.struct("hi2", "lo2", "parts2")).alias("near"))
    )
    around = materialize(around, "around")
    number = lambda hi, lo, part: F.col(hi).cast("long") * 33 + F.col(lo) + F.lit(33 * 33) * part
    own = F.pmod(F.xxhash64("node"), F.col("parts").cast("long"))
    mine = cells.join(around, ["hi", "lo"]).select("node", "fp", number("hi", "lo", own).alias("m"), F.explode("near").alias("n"))
    pairs = mine.select("node", "fp", "m", "n.*").withColumn("part2", F.explode(F.sequence(F.lit(0), F.col("parts2") - 1)))
    pairs = pairs.select("node", "fp", "m", number("hi2", "lo2", F.col("part2")).alias("n"))
    keyed = pairs.select(F.least("m", "n").alias("k1"), F.greatest("m", "n").alias("k2"), (F.col("m") > F.col("n")).cast("int").alias("side"), "node", "fp")

    return _links_within(keyed.select(F.lit(0).cast("long").alias("g"), "k1", "k2", "side", "node", "fp"), radius)


def _links_within(keyed: DataFrame, radius: int) -> DataFrame:
    """(g, k1, k2, side, node, fp) -> links (u, v): pairs of a group (g, k1, k2) within radius, inside it where k1 = k2,
    else between its sides 0 and 1. A group returns a forest, at most one link a node, never all pairs."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_runs(batches, ["g", "k1", "k2"]):
            k1, k2, side, nodes = (rows.column(c).to_numpy() for c in ("k1", "k2", "side", "node"))
            words = rows.column("fp").combine_chunks().flatten().to_numpy().reshape(len(nodes), -1).view(np.uint64)
            u, v = [], []
            for s, e in zip(starts, [*starts[1:], rows.num_rows], strict=True):
                ids, fp, same = nodes[s:e], words[s:e], k1[s] == k2[s]
                cut = len(ids) if same else int(np.count_nonzero(side[s:e] == 0))
                b = 0 if same else cut
                if len(ids) < 2 or not cut or b == len(ids):
                    continue
                order = np.argsort(ids)
                rank = np.empty(len(ids), np.int64)
                rank[order] = np.arange(len(ids))
                label = np.arange(len(ids))
                for i, j in near_pairs(fp[:cut], fp[b:], radius):
                    label = min_labels(len(ids), rank[i], rank[b + j], label)
                joined = np.flatnonzero(label != np.arange(len(ids)))
                if len(joined):
                    ids = ids[order]
                    u.append(ids[joined])
                    v.append(ids[label[joined]])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    return keyed.repartition("g", "k1", "k2").sortWithinPartitions("g", "k1", "k2", "side").mapInArrow(kernel, "u long, v long")


def sketches(own: np.ndarray, bands: int, rows: int) -> list[int]:
    """`bands` hashes of `rows` minima each of the set of shingle hashes, under seeded bijections; none for an empty set.
    Two sets with Jaccard similarity s share one with probability 1 - (1 - s^rows)^bands."""
    if not len(own):
        return []
    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 2048):  # bounded memory at any length
        z = own[at : at + 2048, None] * _ODD[: bands * rows] + _ADD[: bands * rows]
        low = np.minimum(low, (z ^ (z >> np.uint64(32))).min(0))
    key = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        key = _mixed(key ^ low[r::rows], 1)
    return key.view(np.int64).tolist()


def sketched_links(classes: DataFrame, radius: int, tile: int) -> DataFrame:
    """(node, fp, bands) -> links (u, v) of nodes that join exactly those that share a band and lie within radius,
    transitively. A band of more than `tile` nodes is split by hash into parts whose pairs are groups of their own."""
    rows = materialize(classes.select("node", "fp", F.explode("bands").alias("g")), "bands")
    busy = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    busy = materialize(busy.select(F.col("g").alias("b"), F.ceil(F.col("n") / tile).cast("int").alias("parts")), "busy")
    rows = marked(rows, "again", F.col("g"), busy.select("b"), bits=26).where("again").join(busy.hint("merge"), F.col("g") == F.col("b"))
    rows = rows.withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int"))
    rows = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keyed = rows.select("g", F.least("p", "q").alias("k1"), F.greatest("p", "q").alias("k2"), (F.col("p") > F.col("q")).cast("int").alias("side"), "node", "fp")
    return _links_within(keyed, radius)


def simhash_components(
    docs: DataFrame, shingle: int = 3, radius: int = 3, width: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs.

    Rows link when their fingerprints of `width` 64-bit words differ in at most `radius` bits; component_id is the
    smallest doc_id reachable. A null text counts as empty (fingerprint 0); rows with equal doc_ids are separate rows;
    a null doc_id is no component_id unless a component has no other. Equal fingerprints are joined before the
    comparison, so a group of copies of any size is one node. An empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, shingle, width, id_col, text_col), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    node = F.col("fp")[0] if width == 1 else F.xxhash64("fp")  # 64 bits name a class
    classes = materialize(classes.withColumn("node", node), "classes")
    roots = connected_components(tile_links(classes.select("node", "fp"), radius))
    named = classes.join(roots, "node", "left").select("fp", "first_id", F.coalesce("root", "node").alias("root"))
    named = materialize(named, "named")
    lowest = materialize(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "lowest")
    named = materialize(named.join(lowest, "root").select("fp", "component_id"), "members")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def shingle_classes(docs: DataFrame, shingle: int, width: int, bands: int, band_rows: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, node, fp, bands) per row: hash of the text, 64 bits that name its set of shingles, the set's SimHash
    and its sketches."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, fps, keys = [], [], []
            for t in b.column(2):
                own = np.unique(shingle_hashes(t.as_py(), shingle))
                nodes.append(xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63))
                fps.append(simhash(own, width))
                keys.append(sketches(own, bands, band_rows))
            columns = [b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(fps, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "node", "fp", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(kernel, "doc_id long, key long, node long, fp array<long>, bands array<long>")


def similar_links(members: DataFrame, radius: int, similarity: float, tile: int) -> DataFrame:
    """(root, node, fp, grams) of groups of candidates -> links (u, v) of nodes of one root that join exactly those
    within radius whose sets of grams have a Jaccard similarity of at least `similarity`, transitively.

    A group of more than `tile` nodes is split by hash into parts whose pairs are compared as groups of their own, so
    no task holds more than two parts of one. Each returns a forest; pairs that it joins already are not compared.
    """
    sizes = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("parts"))
    rows = members.join(materialize(sizes, "groups"), "root").withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int"))
    rows = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("root", F.least("p", "q").alias("p1"), F.greatest("p", "q").alias("p2"), (F.col("p") > F.col("q")).cast("int").alias("side"), "node", "fp", "grams")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_runs(batches, ["root", "p1", "p2"]):
            p1, p2, side, nodes = (rows.column(c).to_numpy() for c in ("p1", "p2", "side", "node"))
            words = rows.column("fp").combine_chunks().flatten().to_numpy().reshape(len(nodes), -1).view(np.uint64)
            lists = rows.column("grams").combine_chunks()
            flat, at = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            u, v = [], []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows], strict=True):
                same = p1[s] == p2[s]
                cut = e if same else s + int(np.count_nonzero(side[s:e] == 0))
                kinds, gram = np.unique(flat[at[s] : at[e]], return_inverse=True)
                own = [gram[a - at[s] : b - at[s]] for a, b in zip(at[s:e], at[s + 1 : e + 1], strict=True)]
                label, size = np.arange(e - s), np.diff(at[s : e + 1])
                for i in range(s, cut):
                    b = i + 1 if same else cut
                    near = np.bitwise_count(words[b:e] ^ words[i]).sum(1) <= radius
                    x, mark = i - s, np.zeros(len(kinds), bool)
                    mark[own[x]] = True
                    for y in (b - s + np.flatnonzero(near & (label[b - s :] != label[x]))).tolist():
                        if label[x] == label[y]:
                            continue
                        both = np.count_nonzero(mark[own[y]])
                        if both and both >= similarity * (size[x] + size[y] - both) - 1e-9:
                            label[label == label[y]] = label[x]
                            u.append(nodes[i])
                            v.append(nodes[s + y])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return rows.repartition("root", "p1", "p2").sortWithinPartitions("root", "p1", "p2", "side").mapInArrow(kernel, "u long, v long")


def simhash_dedup(
    docs: DataFrame, shingle: int = 5, radius: int = 48, width: int = 3, similarity: float = 0.8, tile: int = 2048, part: int = 512,
    bands: int = 14, band_rows: int = 4, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id. Columns as in docs.

    Texts link when their sets of five-word shingles have a Jaccard similarity of at least `similarity`, computed for
    every pair whose SimHashes lie within radius: at 0.8 about 29 to 36 of the 192 bits differ, and in unrelated texts
    a half. At that radius population counts skip next to nothing, so the tiled comparison runs inside groups that
    share one of `bands` sketches of `band_rows` minima, and its work grows with the texts and not with their square:
    a pair at exactly 0.8 shares none with a probability of 0.06 %, one at 0.85 of 0.002 %. Rows without doc_id are kept
    as they are and link nothing. Rows are decided by doc_id and text: different texts with one doc_id are different
    documents, of rows equal in both one stays. Texts without words are one group.
    """
    grouped = docs.where(F.col(id_col).isNotNull())
    rows = materialize(shingle_classes(grouped, shingle, width, bands, band_rows, id_col, text_col), "fingerprints")
    classes = rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.min(F.struct("doc_id", "key")).alias("first"))
    classes = materialize(classes, "classes")
    groups = connected_components(sketched_links(classes, radius, tile))
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    # merge joins at every size: what they find grows with the documents, so no side of theirs stays small
    groups = classes.join(groups.hint("merge"), "node").select("node", "fp", "root", F.col("first.doc_id").alias("i"), F.col("first.key").alias("k"))
    groups = materialize(groups, "candidates")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "key", "grams"])

    # a candidate's shingles are computed where its text is read, and only they are shuffled
    texts = grouped.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    texts = marked(texts, "candidate", F.xxhash64("doc_id", "key"), groups.select(F.xxhash64("i", "k").alias("h"))).where("candidate")
    sets = texts.select("doc_id", "key", "text").mapInArrow(grams, "doc_id long, key long, grams array<long>")
    members = materialize(sets, "grams").join(groups.hint("merge"), (F.col("doc_id") == F.col("i")) & (F.col("key") == F.col("k")))
    members = materialize(members.dropDuplicates(["node"]).select("root", "node", "fp", "grams"), "members")
    roots = connected_components(similar_links(members, radius, similarity, part))
    named = classes.join(roots.hint("merge"), "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    named = materialize(named, "named")
    lowest = materialize(named.groupBy("root").agg(F.min("first").alias("kept")), "lowest")
    named = materialize(named.join(lowest.hint("merge"), "root").select(F.col("node").alias("m"), "kept"), "kept")
    per_row = rows.groupBy("doc_id", "key", "node").agg(F.count(F.lit(1)).alias("n")).join(named.hint("merge"), F.col("node") == F.col("m"))
    gone = F.struct("doc_id", "key") != F.col("kept")
    # rows that go, or are one of several equal ones; all others stay where they are
    touched = materialize(per_row.where(gone | (F.col("n") > 1)).select(F.col("doc_id").alias("i"), F.col("key").alias("k"), gone.alias("gone")), "touched")
    flag, id_, key = fresh(docs, "_touched"), fresh(docs, "_own_id"), fresh(docs, "_text_key")
    own = docs.withColumns({id_: F.col(id_col).cast("long"), key: F.xxhash64(F.col(text_col))})
    own = marked(own, flag, F.xxhash64(id_, key), touched.select(F.xxhash64("i", "k").alias("h")))
    own = own.withColumn(flag, F.col(flag) & F.col(id_).isNotNull())
    goes = touched.where("gone").select(F.col("i").alias(f"{id_}i"), F.col("k").alias(f"{key}k"))
    some = own.where(flag).join(goes.hint("merge"), (F.col(id_) == F.col(f"{id_}i")) & (F.col(key) == F.col(f"{key}k")), "left_anti")
    return own.where(~F.col(flag)).unionByName(some.dropDuplicates([id_, key])).select(*docs.columns)
