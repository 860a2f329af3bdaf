"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text, by sparse matrix products.

Tokens and bytes make incidence matrices A and B (token by byte) in compressed sparse rows. A row of A·Bᵀ holds the B
tokens that share bytes with an A token: the overlap links. Offsets at which tokens of both end cut a text into groups;
incidence matrices of tokens and groups multiply to the links inside groups.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.llm.chunks import byte_letters, list_encoder, pieces, spread
from arborlens.llm.runs import whole_runs
from arborlens.llm.work import materialize, new_path

#: Vocabulary files, which every executor must reach: a byte-level one, and one of pieces that adds a blank in front.
BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
_PLAIN = re.compile(r"[ \n]*[^ \n]+|[ \n]+\Z")
_ODD = re.compile(r"[^\S \n]")
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def chunks_of(text: str) -> list[str]:
    """The text cut behind characters that are no white space, before a blank or a line feed: tokens of both kinds of
    vocabulary end there, and what stands in one chunk has no effect on another."""
    return _CUT.split(text) if _ODD.search(text) else _PLAIN.findall(text)


def piece_bytes(piece: str) -> bytes:
    m = re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", piece)
    return bytes([int(m[1], 16)]) if m else piece.replace("\u2581", " ").encode()


def products(a_ptr: np.ndarray, a_col: np.ndarray, b_ptr: np.ndarray, b_col: np.ndarray, block: int = 1 << 22) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, ptr, columns, values) of A·B for 0/1 matrices in compressed sparse rows, in ranges of rows whose products
    number about `block`: a row of the result is the sum of the rows of B that the row of A names."""
    size = b_ptr[a_col + 1] - b_ptr[a_col]
    ends = np.concatenate([[0], np.cumsum(size)])[a_ptr]  # products before each row
    row = 0
    while row < len(a_ptr) - 1:
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + block, "right")) - 1)
        own = slice(int(a_ptr[row]), int(a_ptr[last]))
        n, cols = size[own], a_col[own]
        take = np.arange(n.sum()) + np.repeat(b_ptr[cols] - (np.cumsum(n) - n), n)
        rows = np.repeat(np.repeat(np.arange(row, last), np.diff(a_ptr[row : last + 1])), n)
        out = b_col[take]
        if len(out) and not ((np.diff(rows) > 0) | (np.diff(out) >= 0)).all():
            order = np.lexsort((out, rows))
            rows, out = rows[order], out[order]
        new = np.ones(len(out), bool)
        new[1:] = (np.diff(rows) != 0) | (np.diff(out) != 0)
        at = np.flatnonzero(new)
        values = np.diff(np.append(at, len(out)))
        yield row, np.concatenate([[0], np.cumsum(np.bincount(rows[at] - row, minlength=last - row))]), out[at], values
        row = last


def _sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of values between the places of ptr."""
    run = np.concatenate([[0], np.cumsum(values)])
    return run[ptr[1:]] - run[ptr[:-1]]


def align(a_len: np.ndarray, b_len: np.ndarray, block: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token lengths in bytes, of A and of B over the same bytes -> (A token, B token) of every overlap link, the group of
    each A token and of each B token, and the number of group links of each A token."""
    a_ptr, b_ptr = np.concatenate([[0], np.cumsum(a_len)]), np.concatenate([[0], np.cumsum(b_len)])
    n = int(a_ptr[-1])
    left, right = [], []
    for row, ptr, cols, _ in products(a_ptr, np.arange(n), np.arange(n + 1), np.repeat(np.arange(len(b_len)), b_len), block):
        left.append(np.repeat(np.arange(row, row + len(ptr) - 1), np.diff(ptr)))
        right.append(cols)
    common = np.intersect1d(a_ptr[1:], b_ptr[1:], assume_unique=True)
    a_group, b_group = np.searchsorted(common, a_ptr[1:]), np.searchsorted(common, b_ptr[1:])
    within = [np.diff(ptr) for _, ptr, _, _ in products(np.arange(len(a_len) + 1), a_group, np.searchsorted(b_group, np.arange(len(common) + 1)), np.arange(len(b_len)), block)]
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(left), join(right), a_group, b_group, join(within)


def _together(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """(first, behind the last) of runs whose lengths add up to `most` at most; what is longer stands alone."""
    first = total = 0
    for k, n in enumerate(lengths):
        if k > first and total + n > most:
            yield first, k
            first, total = k, 0
        total += n
    if lengths:
        yield first, len(lengths)


class _Numbers(dict):
    """The number of each chunk that is asked for: one not held yet gets the next number, and is put down in `new`."""

    def __init__(self, held: list[str]):
        super().__init__(zip(held, range(len(held)), strict=True))
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        self.new.append(chunk)
        return number


class _Chunks:
    """Alignments of distinct chunks, each computed once while it is held: sizes, links (A id << 32 | B id) and groups as text."""

    def __init__(self, byte_level: str, piece_model: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        names = [self.a.id_to_token(k) or "" for k in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(map(byte_of.__getitem__, n)) for n in names]
        names = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [piece_bytes(p) for p in names]
        #: whether no piece reaches over the start of a chunk, or holds the line feed set before one
        self.parts = not any(re.search("[^\u2581]\u2581|\n", p) for p in names)
        self.before = self.b.encode("\n")
        self.encode_a = list_encoder(self.a, most=1 << 15, specials=False)
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        #: an id as it stands in the text of groups: of A inside and at the end of its part, of B the same
        self.shown = [f"{k}{c}" for n, c in ((len(self.a_bytes), ","), (len(self.a_bytes), "|"), (len(self.b_bytes), ","), (len(self.b_bytes), ";")) for k in range(n)]
        self.index = _Numbers([])
        self.text: list[bytes] = []  # empty: the bytes differ
        self.links, self.ptr = array("q"), array("q", [0])
        self.sizes = array("q")  # n_a, n_b, n_groups, n_links, n_group_links of each
        self.asked = np.zeros(0, np.int64)  # how often each occurred; what was before a trim counts half

    def full(self, most: int) -> bool:
        return len(self.index) > most or len(self.links) > 8 * most

    def trim(self, most: int) -> None:
        """Keep the chunks that occurred most often, and more than once: `most` chunks and 8 * most links at most. All get new
        numbers."""
        ptr, sizes = np.frombuffer(self.ptr, np.int64), np.frombuffer(self.sizes, np.int64).reshape(-1, 5)
        order = np.argsort(-self.asked, kind="stable")[:most]
        keep = np.sort(order[(self.asked[order] > 1) & (np.cumsum(np.diff(ptr)[order]) <= 8 * most)])
        n = ptr[keep + 1] - ptr[keep]
        names, links = list(self.index), np.frombuffer(self.links, np.int64)[spread(ptr[keep], n)]
        self.index = _Numbers([names[k] for k in keep.tolist()])
        self.text = [self.text[k] for k in keep.tolist()]
        self.links, self.ptr = array("q", links.tobytes()), array("q", np.concatenate([[0], np.cumsum(n)]).astype(np.int64).tobytes())
        self.sizes, self.asked = array("q", sizes[keep].tobytes()), self.asked[keep] >> 1

    def _encode_b(self, chunks: list[str]) -> list[list[int]]:
        n = len(self.before)
        coded = self.b.encode(["\n" + c for c in chunks], num_threads=1)
        return [x[n:] if x[:n] == self.before else [] for x in coded]

    def _matrices(self, coded: list[list[int]], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, rows before each chunk, bytes of each chunk)"""
        ids = np.fromiter(chain.from_iterable(coded), np.int64)
        ptr = np.concatenate([[0], np.cumsum([len(x) for x in coded])]).astype(np.int64)
        return ids, ptr, _sums(lengths[ids], ptr)

    def add(self, new: list[str]) -> None:
        a, b = list(self.encode_a(new)), self._encode_b(new)
        (a_ids, a_ptr, a_own), (b_ids, b_ptr, b_own) = self._matrices(a, self.a_len), self._matrices(b, self.b_len)
        raw, good = [c.encode() for c in new], [True] * len(new)
        sizes, whole = np.array([len(r) for r in raw]), b"".join(raw)
        join = lambda ids, table: b"".join(map(table.__getitem__, ids))
        # whether the tokens of each chunk join to its bytes: of all at once, else one by one
        if not (np.array_equal(a_own, sizes) and np.array_equal(b_own, sizes) and join(a_ids.tolist(), self.a_bytes) == whole == join(b_ids.tolist(), self.b_bytes)):
            good = [join(a[k], self.a_bytes) == r == join(b[k], self.b_bytes) for k, r in enumerate(raw)]
            a, b = ([x if g else [] for x, g in zip(coded, good, strict=True)] for coded in (a, b))
            (a_ids, a_ptr, _), (b_ids, b_ptr, _) = self._matrices(a, self.a_len), self._matrices(b, self.b_len)
        left, right, a_group, b_group, within = align(self.a_len[a_ids], self.b_len[b_ids])
        links = a_ids[left] << 32 | b_ids[right]
        link_ptr = np.searchsorted(left, a_ptr)
        groups = int(a_group[-1]) + 1 if len(a_group) else 0
        a_at, b_at = np.searchsorted(a_group, np.arange(groups + 1)), np.searchsorted(b_group, np.arange(groups + 1))
        g_ptr = np.searchsorted(a_at[:-1], a_ptr)  # groups before each chunk
        # the text of groups: every token in its place, with the sign that follows it
        signs = np.empty(len(a_ids) + len(b_ids), np.int64)
        ends_a, ends_b = np.zeros(len(a_ids), bool), np.zeros(len(b_ids), bool)
        ends_a[a_at[1:] - 1], ends_b[b_at[1:] - 1] = True, True
        na, nb = len(self.a_bytes), len(self.b_bytes)
        signs[np.arange(len(a_ids)) + b_at[a_group]] = a_ids + na * ends_a
        signs[np.arange(len(b_ids)) + a_at[b_group + 1]] = 2 * na + b_ids + nb * ends_b
        shown, at = list(map(self.shown.__getitem__, signs.tolist())), (a_ptr + b_ptr).tolist()
        sizes = np.stack([np.diff(a_ptr), np.diff(b_ptr), np.diff(g_ptr), np.diff(link_ptr), _sums(within, a_ptr)], axis=1)
        self.text += ["".join(shown[i:j])[:-1].encode() if g else b"" for i, j, g in zip(at, at[1:], good, strict=False)]
        base = self.ptr[-1]
        self.links.frombytes(links.astype(np.int64).tobytes())
        self.ptr.frombytes((link_ptr[1:] + base).astype(np.int64).tobytes())
        self.sizes.frombytes(sizes.astype(np.int64).tobytes())

    def numbers(self, chunks: list[str], size: int = 1 << 16) -> np.ndarray:
        """New chunks are aligned `size` characters at a time, as that takes some hundred bytes for each."""
        out = np.fromiter(map(self.index.__getitem__, chunks), np.uint32, len(chunks))
        new, self.index.new = self.index.new, []
        for a, b in _together([len(c) for c in new], size):
            self.add(new[a:b])
        return out


_BLOCK = (
    "block long, doc_ids array<bigint>, sizes array<bigint>, shas array<string>, used array<bigint>, occurrences binary, chunk_links binary, chunk_pairs binary, pairs binary, counts binary"
)


def _packed(numbers: np.ndarray, most: int) -> bytes:
    """Numbers below `most` in two bytes each where they fit, else in four."""
    return numbers.astype("<u2" if most <= 1 << 16 else "<u4").tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


class _Block:
    """Documents of one block: their sizes and digests, and the numbers of their chunks."""

    def __init__(self, chunks: _Chunks):
        self.chunks, self.ids, self.shas, self.used, self.held, self.chars = chunks, [], [], [], [], 0

    def push(self, doc_ids: list[int | None], texts: list[str], size: int = 1 << 18) -> None:
        """Documents in order, of `size` characters at most, whose chunks are looked up together; a longer document comes alone
        and is taken in pieces."""
        self.chars += sum(map(len, texts))
        if len(texts[0]) > size and self.chunks.parts:
            self._push_long(doc_ids[0], texts[0], size)
            return
        own = [[] if not t else chunks_of(" " + t) if self.chunks.parts else [" " + t] for t in texts]
        numbers = self.chunks.numbers(list(chain.from_iterable(own)))
        shown, at = list(map(self.chunks.text.__getitem__, numbers.tolist())), 0
        for doc_id, end in zip(doc_ids, accumulate(map(len, own)), strict=True):
            part = shown[at:end]
            good = bool(part) and all(part)
            self._put(doc_id, hashlib.sha256(b";".join(part)) if good else None, [numbers[at:end]] if good else [])
            at = end

    def _push_long(self, doc_id: int | None, text: str, size: int) -> None:
        held, sha = [], hashlib.sha256()
        for part, _ in pieces(" " + text, size):
            numbers = self.chunks.numbers(chunks_of(part))
            shown = list(map(self.chunks.text.__getitem__, numbers.tolist()))
            if not all(shown):
                self._put(doc_id, None, [])
                return
            sha.update(b";" * bool(held) + b";".join(shown))
            held.append(numbers)
        self._put(doc_id, sha, held)

    def _put(self, doc_id: int | None, sha, held: list[np.ndarray]) -> None:
        self.ids.append(doc_id)
        self.shas.append(sha.hexdigest() if sha else "")
        self.used.append(sum(map(len, held)))
        self.held += held

    def row(self, number: int) -> pa.RecordBatch:
        every = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        sizes, ends = np.frombuffer(self.chunks.sizes, np.int64).reshape(-1, 5), np.concatenate([[0], np.cumsum(self.used)]).astype(np.int64)
        sizes = np.stack([_sums(sizes[:, c][every], ends) for c in range(5)], axis=1)
        times = np.bincount(every, minlength=len(self.chunks.text))
        self.chunks.asked = times + np.pad(self.chunks.asked, (0, len(times) - len(self.chunks.asked)))
        known = np.flatnonzero(times)
        occurrences = (np.cumsum(times > 0) - 1)[every]
        ptr, links = np.frombuffer(self.chunks.ptr, np.int64), np.frombuffer(self.chunks.links, np.int64)
        n = ptr[known + 1] - ptr[known]
        pairs, chunk_pairs = np.unique(links[spread(ptr[known], n)], return_inverse=True)
        counts = np.bincount(chunk_pairs, np.repeat(times[known], n), minlength=len(pairs)).astype("<i8")
        row = [number, self.ids, sizes.ravel(), self.shas, self.used, _packed(occurrences, len(known)), n.astype("<u4").tobytes(), _packed(chunk_pairs, len(pairs)), pairs.astype("<i8").tobytes(), counts.tobytes()]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64())] + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=[x.split()[0] for x in _BLOCK.split(", ")])


def aligned_blocks(
    docs: DataFrame, byte_level: str = BYTE_LEVEL, piece_model: str = PIECES, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 1 << 22, most_chunks: int = 1 << 18
) -> DataFrame:
    """Written blocks of about block_chars characters of whole texts: each document's sizes and digest and the chunks that it
    consists of, each chunk's links, and the block's distinct id pairs with their numbers of links. A task holds one block, and
    the alignments of about most_chunks chunks and eight times as many links: when they are more, the block ends and the
    frequent ones stay, up to half."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunks = TaskContext.get().partitionId() << 32, _Chunks(byte_level, piece_model)
        block, size = _Block(chunks), max(1, min(1 << 18, block_chars >> 4))
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                part = whole.slice(at, 64)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                for a, b in _together([len(t) for t in texts], size):
                    block.push(ids[a:b], texts[a:b], size)
                    if block.chars >= block_chars or chunks.full(most_chunks):
                        yield block.row(number)
                        if chunks.full(most_chunks):
                            chunks.trim(most_chunks // 2)
                        number, block = number + 1, _Block(chunks)
        if block.ids:
            yield block.row(number)

    path = new_path(docs.sparkSession, "aligned")
    # Spark's writer and reader hold the rows of a file together, which number few and are long
    rows.mapInArrow(kernel, _BLOCK).write.option("compression", "zstd").option("maxRecordsPerFile", 4).parquet(path)
    return docs.sparkSession.read.parquet(path)


def _pair_rows(blocks: DataFrame) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(whole.num_rows):
                r = whole.slice(k, 1).to_pylist()[0]
                pairs, counts = np.frombuffer(r["pairs"], "<i8"), np.frombuffer(r["counts"], "<i8")
                for at in range(0, len(pairs), 1 << 16):
                    p = pairs[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), r["block"])), pa.array(p), pa.array(counts[at : at + (1 << 16)])], names=["block", "pair", "n"])

    return blocks.select("block", "pairs", "counts").mapInArrow(kernel, "block long, pair long, n long")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """a_id, b_id, n, best of every pair that any text links: its number of links in all texts, and whether that is its B id's
    highest. What is broadcast has at most a row for each id of B."""
    totals = materialize(_pair_rows(blocks).groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    totals = totals.select("pair", "n", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b_id"))
    high = materialize(totals.groupBy(F.col("b_id").alias("b")).agg(F.max("n").alias("high")), "highest")
    out = totals.join(F.broadcast(high), F.col("b_id") == F.col("b"))
    return out.select("pair", F.shiftright("pair", 32).alias("a_id"), "b_id", "n", (F.col("n") == F.col("high")).alias("best"))


def alignments(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_group_links, n_best, count_sum, groups_sha256 of every row of docs.

    Texts are encoded without special tokens, with a blank in front. A text that is null or empty, or whose tokens do not
    join to its own bytes, has no tokens: zeros, and '' for a digest. Rows without doc_id and repeated rows are rows like others;
    other columns are not read. Distinct chunks are aligned once in a task while it holds them; a document's links are those
    of its chunks. A pair's count is summed over all blocks, and each block gets the counts of its own pairs back.
    A group of tokens that never end together costs the product of its sizes, in bounded memory.
    """
    blocks = aligned_blocks(docs, **options)
    known = pair_counts(blocks).select(F.col("pair").alias("p"), F.col("n").alias("total"), "best")
    back = _pair_rows(blocks).select("block", "pair").join(known, F.col("pair") == F.col("p")).select("block", "pair", "total", "best")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs, starts in whole_runs(batches, ["block"]):
            number, total, best = runs.column("block").to_numpy(), runs.column("total").to_numpy(), np.asarray(runs.column("best"), bool)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(number)], strict=True):
                row = [pa.array([number[a]], pa.int64()), pa.array([total[a:b].astype("<i8").tobytes()], pa.binary()), pa.array([best[a:b].astype("u1").tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=["k", "total", "best"])

    answers = back.repartition("block").sortWithinPartitions("block", "pair").mapInArrow(pack, "k long, total binary, best binary")
    # the few answers of a partition are hashed, so that the blocks pass by one at a time and are not sorted
    joined = blocks.drop("pairs", "counts").join(answers.hint("shuffle_hash"), F.col("block") == F.col("k"), "left")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_group_links long, n_best long, count_sum long, groups_sha256 string"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(whole.num_rows):
                r = whole.slice(k, 1).to_pylist()[0]
                at = np.concatenate([[0], np.cumsum(np.frombuffer(r["chunk_links"], "<u4"))]).astype(np.int64)
                pair = _unpacked(r["chunk_pairs"], int(at[-1]))
                total, best = np.frombuffer(r["total"] or b"", "<i8"), np.frombuffer(r["best"] or b"", "u1")
                sums, bests = _sums(total[pair], at), _sums(best[pair].astype(np.int64), at)
                used = np.concatenate([[0], np.cumsum(r["used"])]).astype(np.int64)
                chunk = _unpacked(r["occurrences"], int(used[-1]))
                sizes = np.array(r["sizes"], np.int64).reshape(-1, 5)
                columns = [pa.array(r["doc_ids"], pa.int64()), *[pa.array(sizes[:, c]) for c in range(5)]]
                columns += [pa.array(_sums(bests[chunk], used)), pa.array(_sums(sums[chunk], used)), pa.array(r["shas"], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in out.split(", ")])

    return joined.mapInArrow(score, out)
