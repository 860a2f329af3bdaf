"""Substring duplicates: sliding spans of sentences, hashed and joined over the whole corpus."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.llm.work import marked, materialize, text_keys

_END = re.compile(r"[.!?…。！？]+\s+|\n\s*")
_WORD = re.compile(r"\S+\s*")
_SPACE = str.maketrans(dict.fromkeys(range(9, 14), " "))


def sentences(text: str, longest: int = 24) -> list[tuple[int, int]]:
    """(start, end) of the text's sentences, without gaps. A sentence of more than `longest` words is cut behind words
    chosen by their own hash (one in eight), so that a passage is cut alike wherever it stands."""
    out, at = [], 0
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        if end <= at:
            continue
        if end - at > 2 * longest and text.count(" ", at, end) + 1 > longest:
            words = list(_WORD.finditer(text, at, end))
            if len(words) > longest:
                for w in words[:-1]:
                    if zlib.crc32(w[0].strip().lower().encode("utf-8", "surrogatepass")) & 7 == 0:
                        out.append((at, w.end()))
                        at = w.end()
        out.append((at, end))
        at = end
    return out


def spans(text: str, run: int = 3, words: int = 15, longest: int = 24) -> Iterator[tuple[int, int, int, int]]:
    """(first sentence, sentences, two hash words) of each sliding span: every run of `run` consecutive sentences, and
    every shorter one, of two at least, that holds `words` words or is the whole text. Longer repeats are made of these.
    Case and white space do not count."""
    units = [text[s:e].lower().split() for s, e in sentences(text, longest)]
    joined = [" ".join(u).encode("utf-8", "surrogatepass") for u in units]
    sizes = [len(u) for u in units]
    for i in range(len(units) - 1):
        if not sizes[i]:
            continue
        total = sizes[i]
        for n in range(2, min(run, len(units) - i) + 1):
            total += sizes[i + n - 1]
            if n == run or total >= words or n == len(units):
                h = xxhash.xxh3_128_digest(b"\n".join(joined[i : i + n]))
                yield i, n, int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def repeated_spans(docs: DataFrame, run: int = 3, words: int = 15, longest: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k1, first, n): every occurrence but the first, by doc_id, text and place, of a span that occurs more than
    once; k1 is the first of the text's keys.

    Occurrences are counted by half of their hash with partial sums. A bitmap of the halves that occur again then leaves
    few of the others, and only what it leaves is grouped by the whole hash and joined with its origin.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "k1", "first", "n", "h1", "h2"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [(no, *s) for no, t in enumerate(part.column(2).to_pylist()) for s in spans(t, run, words, longest)]
                if rows:
                    no, *cols = zip(*rows, strict=True)
                    own = part.select([0, 1]).take(pa.array(no))
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=names)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_keys(text_col)["k1"].alias("k1"), F.col(text_col).alias("text"))
    texts = texts.where("text is not null")
    found = materialize(texts.mapInArrow(kernel, "doc_id long, k1 long, first int, n int, h1 long, h2 long"), "spans")
    often = materialize(found.groupBy("h1").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("h1"), "often")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "first", "n")  # texts without id come last
    found = materialize(marked(found, "again", F.col("h1"), often, bits=26).where("again").select("h1", "h2", place.alias("place")), "again")
    origin = found.groupBy("h1", "h2").agg(F.min("place").alias("origin"), F.max("place").alias("last"))
    origin = materialize(origin.where(~F.col("last").eqNullSafe(F.col("origin"))).drop("last"), "origins")
    return found.join(origin, ["h1", "h2"]).where(~F.col("place").eqNullSafe(F.col("origin"))).select("place.doc_id", "place.k1", "place.first", "place.n")


def substring_dedup(
    docs: DataFrame, run: int = 3, words: int = 15, longest: int = 24, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, text, n_sentences, n_removed, removed (character spans) of the documents that lose sentences.

    A span is a run of `run` consecutive sentences, or a shorter one, of two at least, that holds `words` words or is
    the whole text; every sentence covered by an occurrence of a repeated span other than the first (smallest doc_id,
    then text and place) is removed, and the rest of the text stays as it is. Documents without a repeat are not
    returned; null texts are left alone; a text without doc_id is a document after all others. A document is a doc_id with a text: different texts with one
    doc_id lose their own sentences only, and rows equal in both are one document, of which every row is returned. A
    span in a third of all documents is counted by partial sums and its occurrences are split by adaptive execution.
    """
    hits = repeated_spans(docs, run, words, longest, id_col, text_col)
    cover = hits.groupBy(F.col("doc_id").alias("d"), F.col("k1").alias("k")).agg(F.collect_set(F.struct("first", "n")).alias("spans"))
    cover = materialize(cover, "cover")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_keys(text_col)["k1"].alias("k1"), F.col(text_col).alias("text")).where("text is not null")
    rows = marked(rows, "hit", F.col("k1"), cover.select("k")).where("hit").join(cover, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("k1") == F.col("k")))
    rows = rows.select("doc_id", "text", "spans")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_sentences", pa.int32()), ("n_removed", pa.int32()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                out = []
                for r in batch.slice(at, 128).to_pylist():
                    units = sentences(r["text"], longest)
                    gone = bytearray(len(units))
                    for s in r["spans"]:
                        gone[s["first"] : s["first"] + s["n"]] = b"\1" * len(gone[s["first"] : s["first"] + s["n"]])
                    removed: list[dict] = []
                    for (s, e), g in zip(units, gone, strict=True):
                        if g and removed and removed[-1]["end"] == s:
                            removed[-1]["end"] = e
                        elif g:
                            removed.append({"start": s, "end": e})
                    text = "".join(r["text"][s:e] for (s, e), g in zip(units, gone, strict=True) if not g)
                    out.append({"doc_id": r["doc_id"], "text": text, "n_sentences": len(units), "n_removed": sum(gone), "removed": removed})
                yield pa.RecordBatch.from_pylist(out, schema)

    return rows.mapInArrow(kernel, "doc_id long, text string, n_sentences int, n_removed int, removed array<struct<start:int,end:int>>")
