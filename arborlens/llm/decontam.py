"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.llm.work import materialize, text_keys, without

#: ASCII punctuation and space part words; letters beyond ASCII are kept as they are.
_PARTS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)
_LANES = 256 * np.arange(8)
_P = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_PARTS).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes; it depends on their order and on k."""
    n = len(words) - k + 1
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = (h ^ words[j : j + n]) * np.uint64(_P)
        h ^= h >> np.uint64(29)
    return h


def simhash(h: np.ndarray) -> int:
    octets = h.view(np.uint8).reshape(-1, 8) + _LANES
    ones = np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def weighted_similarity(a: list[bytes], b: list[bytes], k: int) -> float:
    """Sum of the smaller over the sum of the larger counts of word shingles."""
    k = min(k, len(a), len(b)) or 1
    x, y = (Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for w in (a, b))
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def _items(benchmark: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(inum, item_id, n, fp, words, hits) of the items with words; inum tells rows apart, whatever their ids."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("item_id", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("words", pa.string()), ("hits", pa.list_(pa.int64()))])
        for b in batches:
            out = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                if words:
                    h = shingle_hashes(word_hashes(words), min(shingle, len(words)))
                    out.append({"item_id": item, "n": len(words), "fp": simhash(h), "words": b" ".join(words).decode("utf-8", "surrogatepass"), "hits": np.unique(h).view(np.int64).tolist()})
            yield pa.RecordBatch.from_pylist(out, schema)

    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    rows = rows.mapInArrow(kernel, "item_id long, n int, fp long, words string, hits array<long>")
    return materialize(rows.select(F.monotonically_increasing_id().alias("inum"), "*"), "items")


def _bitmap(items: DataFrame, least: int = 24, most: int = 27) -> tuple[int, bytes]:
    """Bits (a power of two) and bitmap of the items' shingle hashes by their top bits: 16 bits a shingle, so that few
    others hit it, but never more than 2^most (16 MB), which a benchmark of a hundred million words half fills."""
    shingles = items.agg(F.coalesce(F.sum(F.size("hits")), F.lit(0))).first()[0]
    bits = min(most, max(least, math.ceil(math.log2(16 * shingles + 1))))
    slots = items.select(F.explode("hits").alias("h")).select((F.shiftrightunsigned("h", 64 - bits) + 1).alias("slot"))  # buckets count from 1
    maps = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bytes"))
    seen = bytearray(1 << (bits - 3))
    for r in maps.toLocalIterator():
        at = (r.bucket - 1) * 4096
        seen[at : at + 4096] = bytes(r.bytes)
    return bits, bytes(seen)


def _windows(docs: DataFrame, items: DataFrame, shingle: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, keys, start, n, fp, wkey, words) of the windows that can reach the similarity with any item of their size;
    keys name the document's text and wkey the window's words.

    What is sent to the tasks does not grow with the documents: a bitmap of the items' shingle hashes and one number for
    each item length.
    """
    bits, packed = _bitmap(items)
    lengths = [r.n for r in items.select("n").distinct().orderBy("n").collect()]  # at most one for each length
    send = docs.sparkSession.sparkContext.broadcast((packed, lengths))
    ks = sorted({min(shingle, n) for n in lengths})

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, lengths = send.value
        seen = np.frombuffer(packed, np.uint8)
        names = ["doc_id", "keys", "start", "n", "fp", "wkey", "words"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows, out = batch.slice(at, 256), [], []
                for no, text in enumerate(part.column(2).to_pylist()):
                    words = words_of(text)
                    if not words:
                        continue
                    h = word_hashes(words)
                    grams, sums = {}, {}
                    for k in ks:
                        if k <= len(words):
                            g = shingle_hashes(h, k)
                            slot = (g >> np.uint64(64 - bits)).astype(np.int64)
                            hit = seen[slot >> 3] >> (slot & 7).astype(np.uint8) & 1
                            if hit.any():
                                grams[k], sums[k] = g, np.concatenate(([0], np.cumsum(hit, dtype=np.int64)))
                    for n in lengths if grams else ():
                        k, size = min(shingle, n, len(words)), min(n, len(words))
                        if k not in grams:
                            continue
                        m, own = n - min(shingle, n) + 1, size - k + 1
                        need = math.ceil(similarity * m - 1e-9) if size < n else math.ceil(2 * similarity / (1 + similarity) * m - 1e-9)
                        if sums[k][-1] < need:
                            continue
                        count = sums[k][own:] - sums[k][: len(sums[k]) - own]
                        for s in np.flatnonzero(count >= max(1, need)).tolist():
                            held = b" ".join(words[s : s + size])
                            rows.append(no)
                            out.append((s, n, simhash(grams[k][s : s + own]), xxhash.xxh64_intdigest(held) - (1 << 63), held.decode("utf-8", "surrogatepass")))
                if out:
                    own = part.select([0, 1]).take(pa.array(rows))
                    columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *columns], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_keys(text_col).alias("keys"), F.col(text_col).alias("text")).where("text is not null")
    found = rows.mapInArrow(kernel, "doc_id long, keys struct<k1:long,k2:long>, start int, n int, fp long, wkey long, words string")
    return materialize(found, "windows")


def _fields(radius: int, each: int) -> list[tuple[int, int]]:
    """(first bit, bits) of disjoint fields of a fingerprint, so many that two within radius differ by at most `each` bits
    in one of them."""
    m = radius // (each + 1) + 1
    edges = [round(i * 64 / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _field(fp, at: int, width: int):
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def _near_values(fp, at: int, width: int, each: int, no: int):
    """Array of (k, v): the values of field `no` within `each` bits of the fingerprint's own."""
    flips = [sum(1 << b for b in bits) for n in range(each + 1) for bits in combinations(range(width), n)]
    own = _field(fp, at, width)
    return F.transform(F.array(*[F.lit(x).cast("long") for x in flips]), lambda x: F.struct(F.lit(no).alias("k"), own.bitwiseXOR(x).alias("v")))


def near_fingerprints(windows: DataFrame, items: DataFrame, radius: int, each: int = 2) -> DataFrame:
    """(n, fp, inum): distinct (n, fp) of the windows with the items of their size whose fingerprints lie within radius.

    Multi-index: of radius // (each + 1) + 1 fields, one differs by at most `each` bits in any such pair. The items, the
    smaller side, list every value within `each` bits of their fields; a window is looked up once a field. Only sizes
    and fingerprints are joined; at radius 16 (6 fields, 2 bits) a fifth of the pairs of one size meet in the index.
    """
    fields = _fields(radius, each)
    left = materialize(windows.select("n", "fp").distinct(), "fingerprints")
    left = left.select("n", "fp", F.posexplode(F.array(*[_field(F.col("fp"), *f) for f in fields])).alias("k", "v"))
    index = items.select("inum", F.col("n").alias("m"), F.col("fp").alias("item_fp"), F.explode(F.concat(*[_near_values(F.col("fp"), *f, each, k) for k, f in enumerate(fields)])).alias("i"))
    index = materialize(index.select("inum", "m", "item_fp", "i.*"), "index").withColumnsRenamed({"k": "l", "v": "w"})
    pairs = left.join(index, (F.col("n") == F.col("m")) & (F.col("k") == F.col("l")) & (F.col("v") == F.col("w")))
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    met = F.array(*[F.bit_count(_field(apart, *f)) <= each for f in fields])
    # a pair that meets in several fields counts in the first
    pairs = pairs.where((F.bit_count(apart) <= radius) & (F.array_position(met, True) == F.col("k") + 1))
    return materialize(pairs.select("n", "fp", "inum"), "near")


def near_items(windows: DataFrame, items: DataFrame, radius: int, similarity: float, shingle: int) -> DataFrame:
    """(n, wkey, item_id, similarity): distinct windows with the items of their size whose fingerprints lie within
    radius and whose weighted shingle similarity is at least `similarity`. Words are fetched for such pairs only."""
    near = near_fingerprints(windows, items, radius)
    texts = windows.select("n", "fp", "wkey", "words").join(near.select("n", "fp").distinct().hint("merge"), ["n", "fp"], "left_semi")
    texts = materialize(texts.dropDuplicates(["n", "wkey"]), "words")
    pairs = texts.join(near.hint("merge"), ["n", "fp"]).join(items.select("inum", "item_id", F.col("words").alias("item_words")), "inum")
    pairs = pairs.select("n", "wkey", "item_id", "words", "item_words")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = lambda c: (x.encode("utf-8", "surrogatepass").split() for x in c.to_pylist())
        for b in batches:
            score = [weighted_similarity(x, y, shingle) for x, y in zip(split(b.column(3)), split(b.column(4)), strict=True)]
            out = pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(score, pa.float64())], names=["n", "wkey", "item_id", "similarity"])
            yield out.filter(pa.array([s >= similarity for s in score], pa.bool_()))

    return materialize(pairs.mapInArrow(verify, "n int, wkey long, item_id long, similarity double"), "verified")


def _hits(docs: DataFrame, benchmark: DataFrame, similarity: float, radius: int, shingle: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """(doc_id, keys, start, n, item_id, similarity) of every window that holds an item."""
    items = _items(benchmark, shingle, item_col, item_text_col)
    windows = _windows(docs, items, shingle, similarity, id_col, text_col)
    found = near_items(windows, items, radius, similarity, shingle)
    return windows.select("doc_id", "keys", "start", "n", "wkey").join(found.hint("merge"), ["n", "wkey"])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 16, shingle: int = 5,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words: each document with each benchmark item that it holds, with the
    best of its windows (the first among equals).

    Words are maximal runs of letters and digits, lower case. For every item length, every window of that many words
    (a shorter document is one window) is a candidate unless too few of its shingles occur in any item for the
    similarity to be possible; candidates are fingerprinted, looked up among the items of their size by the fields of
    their fingerprints, and verified exactly. Null texts and texts without words match nothing. Repeated items match
    alike; rows with one doc_id count as one document here, and a null doc_id as one too.
    """
    hits = _hits(docs, benchmark, similarity, radius, shingle, id_col, text_col, item_col, item_text_col)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), "n")).alias("b")
    out = hits.groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.s")).alias("start_word"), F.col("b.n").alias("n_words"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 16, shingle: int = 5,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """docs without those that hold a benchmark item; columns and all other rows unchanged.

    Each row is decided by its own text, so rows without doc_id, or with one that others share, stay unless their text
    holds an item; of equal texts all go or none. Rows without text stay.
    """
    hits = _hits(docs, benchmark, similarity, radius, shingle, id_col, text_col, item_col, item_text_col)
    return without(docs, materialize(hits.select("keys.*").distinct(), "contaminated"), text_col)
