"""Token-ID output: whole texts as ids in ascending order of doc_id, entropy-coded in blocks that decode by themselves.

The folder of a token set holds `frequencies` (id, freq: the table that all blocks share), `manifest` (a row for each
block: which part of the stream it holds, in which file and where) and `blocks/*.rans`. Only what the manifest names
counts, so files of failed or repeated task attempts do no harm. A file is b"RANF1\\n" and blocks, each the coded ids (see
ans.py) and the index of the documents in it: zlib over pieces of (doc_no, pos, n, doc_id, flags).
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborlens.llm import ans
from arborlens.llm.chunks import encoder, pieces
from arborlens.llm.work import materialize, new_path

#: A vocabulary that drops white space, so that a text's ids are those of its chunks; every executor must reach it.
TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
FILE = b"RANF1\n"
MANIFEST = "shard long, block long, first long, n long, file string, at long, coded long, indexed long"
PIECE = np.dtype([("doc_no", "<i8"), ("pos", "<i8"), ("n", "<i8"), ("doc_id", "<i8"), ("flags", "<u1")])  # flags: 1 last piece, 2 no doc_id


def _groups(texts: pa.Array, size: int) -> Iterator[tuple[int, pa.Array, bool]]:
    """(number of the first text, texts or the piece of one, whether they end with it) of about `size` bytes each."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        if ends[at] - before > size:
            for part, last in pieces(texts[at].as_py(), size):
                yield at, pa.array([part]), last
        else:
            yield at, texts.slice(at, to - at), True
        at = to


def text_ids(texts: list[str] | pa.Array, memo: Callable[..., tuple[np.ndarray, np.ndarray]], end: int, size: int = 1 << 22) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(number of the text, ids, whether they are its last) in order, about `size` bytes at a time: Arrow cuts the texts and
    numbers their different words, whose ids `memo` gives."""
    for no, group, last in _groups(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), size):
        words = pc.split_pattern(pc.replace_substring(group, "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        values, n = memo(coded.dictionary, coded.indices.to_numpy())
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(pc.list_value_length(words).to_numpy())].tolist()
        for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
            yield no + k, np.append(values[a:b], np.uint32(end)) if last else values[a:b], last


@lru_cache(maxsize=1)
def _held(tokenizer: str, changed: int) -> tuple[Callable[..., tuple[np.ndarray, np.ndarray]], str]:
    """The encoder and the kind of ids of a vocabulary file as last changed. A Python worker keeps them from task to task: the
    ids are the same whichever task asks, so the vocabulary is read and frequent words are merged once a worker."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer)
    return encoder(own, most=1 << 19), "<u2" if own.get_vocab_size() <= 1 << 16 else "<u4"


class _Blocks:
    """Cuts a stream of documents' ids into blocks of `size` ids."""

    def __init__(self, size: int):
        self.size, self.parts, self.index, self.held, self.no, self.first = size, [], [], 0, 0, 0

    def push(self, doc_no: int, pos: int, doc_id: int | None, ids: np.ndarray, last: bool) -> Iterator[tuple]:
        at = 0
        while at < len(ids) or last:
            part = ids[at : at + self.size - self.held]
            at += len(part)
            whole = last and at == len(ids)
            top = self.index[-1] if self.index else None
            if top and top[0] == doc_no:
                top[2] += len(part)
                top[4] |= int(whole)
            else:
                self.index.append([doc_no, pos, len(part), doc_id or 0, int(whole) | 2 * (doc_id is None)])
            pos += len(part)
            self.parts.append(part)
            self.held += len(part)
            if self.held == self.size:
                yield self.close()
            if whole:
                break

    def close(self) -> tuple:
        out = (self.no, self.first, self.held, np.concatenate(self.parts), np.array([tuple(x) for x in self.index], PIECE))
        self.first, self.no, self.held, self.parts, self.index = self.first + self.held, self.no + 1, 0, [], []
        return out


def _id_blocks(docs: DataFrame, tokenizer: str, end: int, block: int, id_col: str, text_col: str) -> DataFrame:
    """shard, block, first, n, ids, pieces: the ids of all texts in ascending order of doc_id, in blocks. A shard is a range
    of doc_ids; rows without doc_id come first; rows with one doc_id follow a hash of their text, by which they part too."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = F.xxhash64("text")
    rows = rows.repartitionByRange("doc_id", key).sortWithinPartitions("doc_id", key, "text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, kind = _held(tokenizer, os.stat(tokenizer).st_mtime_ns)
        shard, cut, doc_no = TaskContext.get().partitionId(), _Blocks(block), 0

        def row(no: int, first: int, n: int, ids: np.ndarray, index: np.ndarray) -> pa.RecordBatch:
            packed = [pa.array([x], pa.int64()) for x in (shard, no, first, n)]
            packed += [pa.array([x], pa.binary()) for x in (ids.astype(kind).tobytes(), zlib.compress(index.tobytes(), 1))]
            return pa.RecordBatch.from_arrays(packed, names=["shard", "block", "first", "n", "ids", "pieces"])

        for batch in batches:
            ids_of, pos, now = batch.column(0).to_pylist(), 0, -1
            for no, ids, last in text_ids(batch.column(1), memo, end):
                pos = 0 if no != now else pos
                now = no
                for done in cut.push(doc_no + no, pos, ids_of[no], ids, last):
                    yield row(*done)
                pos += len(ids)
            doc_no += batch.num_rows
        if cut.held:
            yield row(*cut.close())

    return rows.mapInArrow(kernel, "shard long, block long, first long, n long, ids binary, pieces binary")


def _ids(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


def _coded(batches: Iterator[pa.RecordBatch], table: ans.Table, lanes: int, every: int, most: int = 8) -> Iterator[tuple[dict, bytes]]:
    """Each row of blocks and its coded ids, up to `most` blocks of one size at a time."""
    for whole in batches:
        sizes, at = whole.column("n").to_pylist(), 0
        while at < len(sizes):
            to = at + 1
            while to < min(len(sizes), at + most) and sizes[to] == sizes[at]:
                to += 1
            rows = whole.slice(at, to - at).to_pylist()
            yield from zip(rows, ans.encode_blocks([_ids(r["ids"], r["n"]) for r in rows], table, lanes, every), strict=True)
            at = to


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path if ":/" in path else f"file://{path}"))


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end: int = 1, block: int = 1 << 17, lanes: int = 256, every: int = 128, bits: int = 18,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Write the ids of every whole text, `end` behind each, to a new folder in ascending order of doc_id.

    Null texts are empty, so they are the end id alone; rows without doc_id come first; equal rows are written as often as
    they occur; other columns are not read. Texts are cut into chunks at blanks, which no id of this kind of vocabulary
    crosses, and each distinct chunk is encoded once while a task's bounded memo holds it. The frequency table counts
    all ids of all texts and has at most one row for an id of the vocabulary.
    """
    spark = docs.sparkSession
    parts = new_path(spark, "ids")
    _id_blocks(docs, tokenizer, end, block, id_col, text_col).write.option("compression", "zstd").parquet(parts)
    blocks = spark.read.parquet(parts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = np.bincount(_ids(data, n))
                if len(more) > len(total):
                    total, more = more, total
                total[: len(more)] += more
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], names=["id", "n"])

    counts = blocks.select("n", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    totals = np.zeros(max((r["id"] for r in counts), default=-1) + 1, np.int64)
    for r in counts:
        totals[r["id"]] = r["n"]
    freq = ans.quantize(totals, bits)
    spark.createDataFrame([(int(k), int(freq[k]), bits) for k in np.flatnonzero(freq)], "id long, freq long, bits int").coalesce(1).write.parquet(f"{path}/frequencies")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, out, was, name, at = ans.Table(freq, bits), None, None, "", 0
        fs, root = _store(path)
        fs.create_dir(f"{root}/blocks", recursive=True)
        for r, coded in _coded(batches, table, lanes, every):
            if out is None or was != (r["shard"], r["block"] - 1):  # a file holds blocks that follow one another
                if out is not None:
                    out.close()
                name = f"{r['shard']:08d}-{r['block']:08d}-{uuid.uuid4().hex}.rans"
                out, at = fs.open_output_stream(f"{root}/blocks/{name}"), len(FILE)
                out.write(FILE)
            was = (r["shard"], r["block"])
            index = r["pieces"] + zlib.crc32(r["pieces"]).to_bytes(4, "little")
            out.write(coded)
            out.write(index)
            row = [*was, r["first"], r["n"], name, at, len(coded), len(index)]
            at += len(coded) + len(index)
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=[x.split()[0] for x in MANIFEST.split(", ")])
        if out is not None:
            out.close()

    blocks.mapInArrow(encode, MANIFEST).write.parquet(f"{path}/manifest")


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray, int]:
    """The manifest with each block's place in the whole stream, and the shared table (at most 2^bits rows)."""
    blocks = spark.read.parquet(f"{path}/manifest")
    shards = blocks.groupBy(F.col("shard").alias("s")).agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.join(shards.select("s", before.alias("before")), F.col("shard") == F.col("s"))
    rows = spark.read.parquet(f"{path}/frequencies").collect()
    freq = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.uint32)
    for r in rows:
        freq[r["id"]] = r["freq"]
    return blocks.withColumn("first", F.col("first") + F.col("before")).drop("s", "before"), freq, rows[0]["bits"] if rows else 1


def read_pieces(spark: SparkSession, path: str, with_ids: bool = True, blocks_a_task: int = 32) -> DataFrame:
    """shard, doc_no, doc_id, pos, n, last, start, ids_crc32 and, if asked for, ids: each document's part in each block.

    pos is the part's place in its document and start its place in the whole stream. Tasks read byte ranges; each block
    decodes by itself, and a block, segment or index whose checksum does not hold raises an error."""
    blocks, freq, bits = _opened(spark, path)
    n = max(1, -(-blocks.count() // blocks_a_task))
    out = "shard long, doc_no long, doc_id long, pos long, n long, last boolean, start long, ids_crc32 long" + ", ids array<int>" * with_ids

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, file, name = ans.Table(freq, bits), None, None
        fs, root = _store(path)
        for whole in batches:
            for r in whole.to_pylist():
                if name != r["file"]:
                    if file is not None:
                        file.close()
                    name = r["file"]
                    file = fs.open_input_file(f"{root}/blocks/{name}")
                data = file.read_at(r["coded"] + r["indexed"], r["at"])
                ids = ans.decode_block(data[: r["coded"]], table)
                packed = data[r["coded"] :]
                if zlib.crc32(packed[:-4]) != int.from_bytes(packed[-4:], "little"):
                    raise ValueError("an index's checksum does not hold")
                index = np.frombuffer(zlib.decompress(packed[:-4]), PIECE)
                ends = np.cumsum(index["n"])
                starts = ends - index["n"]
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [
                    pa.array(np.full(len(index), r["shard"])), pa.array(index["doc_no"]), pa.array(index["doc_id"], mask=index["flags"] & 2 > 0), pa.array(index["pos"]),
                    pa.array(index["n"]), pa.array(index["flags"] & 1 > 0), pa.array(starts + r["first"]), pa.array(crc, pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in out.split(", ")])
        if file is not None:
            file.close()

    rows = blocks.select("shard", "block", "first", "file", "at", "coded", "indexed").repartitionByRange(n, "shard", "block").sortWithinPartitions("shard", "block")
    return rows.mapInArrow(kernel, out)


def crc32_joined(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of bytes put together, from (CRC-32, length) of each part: a CRC moves over n zero bytes as a linear map of
    its 32 bits, whose powers of two are squares."""

    def times(m: list[int], v: int) -> int:
        out = 0
        for k in range(32):
            if v >> k & 1:
                out ^= m[k]
        return out

    total = 0
    for crc, n in parts:
        step, n = [0xEDB88320, *[1 << k for k in range(31)]], 8 * n  # over one zero bit
        while n:
            if n & 1:
                total = times(step, total)
            step = [times(step, v) for v in step]
            n >>= 1
        total ^= crc
    return total


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files. Documents of one block are ready as read; of the
    others only the parts' sums meet."""
    parts = materialize(read_pieces(spark, path, with_ids=False), "pieces")
    whole = parts.where("pos = 0 and last").select("doc_id", "start", F.col("n").alias("n_tokens"), "ids_crc32")
    rest = parts.where("not (pos = 0 and last)").groupBy("shard", "doc_no").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("pos", "n", "ids_crc32"))).alias("parts"),
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = [crc32_joined([(p["ids_crc32"], 4 * p["n"]) for p in parts]) for parts in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rest = rest.select("doc_id", "start", "n_tokens", "parts").mapInArrow(join, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return whole.unionByName(rest)


def token_range(spark: SparkSession, path: str, start: int, n: int) -> DataFrame:
    """(start, ids) parts of the stream's ids start to start + n - 1: only blocks that hold some are read, and each from the
    checkpoint before the first one wanted."""
    blocks, freq, bits = _opened(spark, path)
    some = blocks.where((F.col("first") < start + n) & (F.col("first") + F.col("n") > start))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ans.Table(freq, bits)
        fs, root = _store(path)
        for whole in batches:
            for r in whole.to_pylist():
                with fs.open_input_file(f"{root}/blocks/{r['file']}") as file:
                    data = file.read_at(r["coded"], r["at"])
                size = ans.segment_ids(data)
                a, b = max(start - r["first"], 0), min(start + n - r["first"], r["n"])
                skip = a // size
                ids = ans.decode_block(data, table, skip, -(-b // size))[a - skip * size : b - skip * size]
                yield pa.RecordBatch.from_arrays([pa.array([r["first"] + a], pa.int64()), pa.array([ids.astype(np.int32).tolist()], pa.list_(pa.int32()))], names=["start", "ids"])

    return some.mapInArrow(kernel, "start long, ids array<int>")
