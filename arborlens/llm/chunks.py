"""Tokenizing by chunks: pieces of a text between which no token reaches, each encoded once while a memo holds it."""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa

#: Behind a character that is no white space, before a blank or a line feed: no token of the vocabularies used here reaches across.
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def pieces(text: str, size: int = 1 << 20) -> Iterator[tuple[str, bool]]:
    """(piece, whether it is the last) of about `size` characters each, parted where no chunk is; '' is one empty piece."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()], False
        at = cut.start()
    yield text[at:], True


#: Fixed value: how byte-level vocabularies split a text where they name no pattern of their own.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: how the vocabulary of words splits a text that is composed and in lower case.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Chunks that Arrow may split: printable characters below U+0250, which compose with nothing here, but not U+0130, of
#: which lower case makes two; on them both patterns need no look ahead and miss no character.
_SIMPLE = "[!-~\u00a1-\u012f\u0131-\u024f]*\\z"
_END = "\x1f"  # no simple chunk holds it
#: What Arrow splits by, and the pattern of simple chunks, for each known pattern.
_ARROW = {BYTE_LEVEL_SPLIT: (BYTE_LEVEL_SPLIT.removesuffix(r"|\s+(?!\S)|\s+"), rf"\A ?{_SIMPLE}"), WORD_SPLIT: (WORD_SPLIT, rf"\A{_SIMPLE}")}


def byte_letters() -> list[str]:
    """The letter of every byte in byte-level vocabularies: printable Latin-1 characters stand for themselves, and U+0100 and
    on, in order, for the other bytes."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def _split_of(spec: dict) -> tuple[str | None, bool]:
    """(pattern of the parts that are merged by themselves, whether texts are composed and in lower case) of the kinds of
    vocabulary that are known here; no pattern for others."""
    steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
    cut = spec["pre_tokenizer"] or {}
    cuts = cut.get("pretokenizers", [])
    if spec["normalizer"] is None and cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]:
        return BYTE_LEVEL_SPLIT, False
    if steps == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cuts] == ["Split", "ByteLevel"]:
        split, bytes_ = cuts
        if (split["behavior"], split["invert"], bytes_["use_regex"], bytes_["add_prefix_space"]) == ("Removed", True, False, False):
            return split["pattern"].get("Regex"), True
    return None, False


def list_encoder(own, most: int = 1 << 18, specials: bool = True) -> Callable[[list[str]], Iterator[list[int]]]:
    """ids of chunks by a tokenizers.Tokenizer. Where it is of a known kind, chunks of Latin letters are split here and only the
    merges are asked of it, once for each part held (`most` at most); it encodes all others whole, and with specials
    those that hold a special token."""
    import regex

    spec = json.loads(own.to_str())
    pattern, lower = _split_of(spec)
    special = [t["content"] for t in spec["added_tokens"]] if specials else []
    fits = pattern is not None and all("<" in t for t in special)
    find, letters, model = regex.compile(pattern or "").findall, byte_letters(), own.model
    known: dict[str, list[int]] = {}

    def ids(chunk: str) -> list[int]:
        out = []
        if lower:
            chunk = (chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)).lower()
        for part in find(chunk):
            got = known.get(part)
            if got is None:
                if len(known) >= most:
                    known.clear()
                got = known[part] = [t.id for t in model.tokenize("".join(map(letters.__getitem__, part.encode())))]
            out += got
        return out

    def encode(new: list[str]) -> Iterator[list[int]]:
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            simple = [fits and (c.isascii() or max(c) < "\u0250") and not ("<" in c and any(t in c for t in special)) for c in some]
            whole = own.encode_batch_fast([c for c, s in zip(some, simple, strict=True) if not s], add_special_tokens=False)
            whole = iter([e.ids for e in whole])
            for c, s in zip(some, simple, strict=True):
                yield ids(c) if s else next(whole)

    return encode


def encoder(own, most: int = 1 << 18, specials: bool = True) -> Callable[..., tuple[np.ndarray, np.ndarray]]:
    """Like list_encoder(), for many chunks at once: a function that gives, by a tokenizers.Tokenizer, all ids of chunks in a
    row and how many each has; of the chunks with the numbers `which`, if given. Where the vocabulary is of a known kind,
    Arrow splits simple chunks and only the merges are asked of the tokenizer, once for each part held (`most` at most, and
    those of one call); it encodes all others whole, and with specials those that hold a special token."""
    import pyarrow.compute as pc

    spec = json.loads(own.to_str())
    special = [t["content"] for t in spec["added_tokens"]] if specials else []
    pattern, lower = _split_of(spec)
    kind, letters, model = _ARROW.get(pattern), dict(enumerate(byte_letters())), own.model

    def merge(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, lens = array("I"), array("q")
        for part in parts:
            plain = part.isascii() and part.isalnum()  # such bytes are their own letters
            got = [t.id for t in model.tokenize(part if plain else part.encode().decode("latin-1").translate(letters))]
            ids.extend(got)
            lens.append(len(got))
        return np.array(ids, np.uint32), np.array(lens, np.int64)

    def whole(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, lens = array("I"), array("q")
        for at in range(0, len(chunks), 4096):
            for e in own.encode_batch_fast(chunks[at : at + 4096], add_special_tokens=False):
                ids.extend(got := e.ids)
                lens.append(len(got))
        return np.array(ids, np.uint32), np.array(lens, np.int64)

    parts_held, whole_held = Memo(merge, most), Memo(whole, most)

    def encode(chunks: list[str] | pa.Array, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        chunks = chunks if isinstance(chunks, pa.Array) else pa.array(chunks, pa.string())
        simple = np.zeros(len(chunks), bool)
        if kind is not None:
            found = pc.match_substring_regex(chunks, kind[1])
            for t in special:
                found = pc.and_not(found, pc.match_substring(chunks, t))
            simple = found.to_numpy(zero_copy_only=False)
        lens = np.zeros(len(chunks), np.int64)
        values = []
        if simple.any():
            some = chunks if simple.all() else chunks.filter(pa.array(simple))
            some = pc.replace_substring_regex(pc.utf8_lower(some) if lower else some, kind[0], rf"\0{_END}")
            split = pc.split_pattern(some, _END)
            parts = split.flatten().dictionary_encode()
            ids, n = parts_held(parts.dictionary, parts.indices.to_numpy())
            ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(pc.list_value_length(split).to_numpy())]
            lens[simple] = np.diff(ends, prepend=0)
            values.append(ids)
        if not simple.all():
            rest = chunks.filter(pa.array(~simple)).dictionary_encode()
            ids, lens[~simple] = whole_held(rest.dictionary, rest.indices.to_numpy())
            values.append(ids)
        if len(values) == 1 and which is None:
            return values[0], lens
        first = np.zeros(len(chunks), np.int64)  # the simple ones' ids come first
        order = np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)])
        first[order] = np.cumsum(lens[order]) - lens[order]
        which = np.arange(len(chunks)) if which is None else which
        return np.concatenate(values or [np.zeros(0, np.uint32)])[spread(first[which], lens[which])], lens[which]

    return encode


class Memo:
    """Values of chunks from a function that is called once for each chunk held. When it would hold over `most` chunks or
    `most_values` values, it keeps those of the present call and, up to half of both, the ones asked for last; so memory is
    bounded by that and by the chunks of one call, and frequent chunks stay."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 1 << 19, most_values: int = 1 << 22):
        self.encode, self.most, self.most_values, self.calls = encode, most, most_values, 0
        self.index: dict[str, int] = {}
        self.values, self.ends = array("I"), array("q", [0])
        self.asked = array("q")  # the last call that asked for each chunk

    def _trim(self) -> None:
        asked, ends = np.array(self.asked, np.int64), np.array(self.ends, np.int64)
        lens = np.diff(ends)
        order = np.argsort(-asked, kind="stable")
        fits = (np.arange(1, len(order) + 1) <= self.most // 2) & (np.cumsum(lens[order]) <= self.most_values // 2)
        keep = np.sort(order[fits | (asked[order] == self.calls)])
        names = list(self.index)
        self.index = {names[k]: i for i, k in enumerate(keep.tolist())}
        self.values = array("I", np.array(self.values, np.uint32)[spread(ends[keep], lens[keep])].tobytes())
        self.ends = array("q", np.concatenate([[0], np.cumsum(lens[keep])]).astype(np.int64).tobytes())
        self.asked = array("q", asked[keep].tobytes())

    def _places(self, chunks: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        np.frombuffer(self.asked, np.int64)[at[at >= 0]] = self.calls
        return at

    def __call__(self, chunks: list[str] | pa.Array, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All values, in a row, of the chunks with these numbers in a list of different chunks, and how many each has."""
        if isinstance(chunks, pa.Array):
            chunks = chunks.to_numpy(zero_copy_only=False).tolist()
        self.calls += 1
        at = self._places(chunks)
        if (at < 0).any():
            if len(self.index) + int((at < 0).sum()) > self.most or len(self.values) > self.most_values:
                self._trim()
                at = self._places(chunks)
            gaps, held = np.flatnonzero(at < 0), len(self.index)
            new = [chunks[k] for k in gaps.tolist()]
            values, lens = self.encode(new)
            self.index.update(zip(new, range(held, held + len(new)), strict=True))
            self.values.frombytes(values.astype(np.uint32).tobytes())
            self.ends.frombytes((np.cumsum(lens) + self.ends[-1]).astype(np.int64).tobytes())
            self.asked.frombytes(np.full(len(new), self.calls, np.int64).tobytes())
            at[gaps] = np.arange(held, held + len(new))
        at = at if which is None else at[which]
        ends = np.frombuffer(self.ends, np.int64)
        n = ends[at + 1] - ends[at]
        take = spread(ends[at], n)
        return np.frombuffer(self.values, np.uint32)[take] if len(take) else np.zeros(0, np.uint32), n


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, n numbers long, in a row."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)
