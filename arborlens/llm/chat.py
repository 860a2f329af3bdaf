"""Chat formatting: turn-aligned windows within a token budget, with a loss mask, and the way back."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.llm.work import materialize

#: Ranks of a byte-level vocabulary (base64 token and rank a line), which every executor must reach.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that vocabulary's texts are split before its merges apply.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
START, END = "<|im_start|>", "<|im_end|>"
WINDOW = (
    "conv_id long, window_no long, formatted string, mask array<struct<start:int,end:int>>, n_repeated int, n_turns int,"
    " n_tokens long, oversize boolean"
)
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)


def escape(text: str) -> str:
    """No `<|` is left, so no control string can be; unescape() gives the text back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL)


def format_turn(role: str | None, text: str | None) -> str:
    return f"{START}{escape(role or '').replace(chr(10), chr(92) + 'n')}\n{escape(text or '')}{END}\n"


def parse_turns(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end bound the escaped text and its end mark."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2) + len(END)) for m in _TURN.finditer(formatted)]


def _encoding(path: str):
    """The tokenizer of a file of ranks; control strings are ordinary text to it."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class _Windows:
    """Greedy windows over one conversation's turns as they come; holds one window and the history only."""

    def __init__(self, conv_id: int | None, budget: int, history_turns: int, history_tokens: int):
        self.conv_id, self.budget, self.most, self.most_tokens = conv_id, budget, history_turns, history_tokens
        self.system: tuple | None = None
        self.back: deque = deque(maxlen=history_turns)
        self.head: list = []
        self.new: list = []
        self.no = self.base = self.first = 0
        self.seen = False

    def _open(self, turn: tuple) -> None:
        room = self.budget - (self.system[2] if self.system else 0) - turn[2]
        history, used = [], 0
        for past in reversed(self.back):
            used += past[2]
            if used > min(self.most_tokens, room):
                break
            history.insert(0, past)
        self.head = ([self.system] if self.system else []) + history
        self.base = sum(t[2] for t in self.head)
        self.first = turn[3] - turn[2]  # tokens before this turn: prefix sums, so a span's tokens are a difference

    def push(self, role: str, formatted: str, tokens: int, prefix: int) -> Iterator[dict]:
        turn = (role, formatted, tokens, prefix)
        if self.new and self.base + prefix - self.first > self.budget:
            yield self.close()
        if not self.new:
            self._open(turn)
        self.new.append(turn)

    def close(self) -> dict:
        parts, mask, at = [], [], 0
        for k, (role, formatted, _, _) in enumerate(self.head + self.new):
            if k >= len(self.head) and role == "assistant":
                mask.append({"start": at + formatted.index("\n") + 1, "end": at + len(formatted) - 1})
            parts.append(formatted)
            at += len(formatted)
        n = self.base + self.new[-1][3] - self.first
        out = {
            "conv_id": self.conv_id, "window_no": self.no, "formatted": "".join(parts), "mask": mask, "n_repeated": len(self.head),
            "n_turns": len(self.new), "n_tokens": n, "oversize": n > self.budget,
        }
        if self.no == 0 and self.new[0][0] == "system":
            self.system = self.new[0]
            self.back.extend(self.new[1:])
        else:
            self.back.extend(self.new)
        self.no, self.new = self.no + 1, []
        return out


def chat_windows(
    turns: DataFrame, budget: int = 1024, history_turns: int = 2, history_tokens: int = 256, tokenizer: str = TOKENIZER
) -> DataFrame:
    """conv_id, turn, role, text -> training windows (WINDOW) of at most `budget` tokens.

    Tokens are counted turn by turn before any shuffle; prefix sums over a conversation then choose the longest span of
    whole turns that fits behind what is repeated: the leading system turn and up to history_turns earlier turns of at
    most history_tokens. Only assistant turns that are new in a window are under its mask (escaped text and end mark, in
    code points), so each is a target once. A turn that does not fit alone is a window of its own, marked oversize;
    none is cut or dropped. Null roles and texts are empty; rows with equal turn follow role and text; a null turn comes
    first; rows without conv_id form one conversation. A conversation streams through one task, in constant memory.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _encoding(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                formatted = [format_turn(r, x) for r, x in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
                tokens = [len(t.encode_ordinary(x)) for x in formatted]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(formatted), pa.array(tokens, pa.int64())], names=["conv_id", "turn", "role", "formatted", "tokens"])

    counted = rows.mapInArrow(count, "conv_id long, turn long, role string, formatted string, tokens long")
    order = ["conv_id", "turn", "role", "formatted"]
    counted = counted.repartition("conv_id").sortWithinPartitions(*order)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("window_no", pa.int64()), ("formatted", pa.string()), ("mask", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("n_repeated", pa.int32()), ("n_turns", pa.int32()), ("n_tokens", pa.int64()), ("oversize", pa.bool_())])
        now: _Windows | None = None
        prefix = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                out = []
                for r in whole.slice(at, 256).to_pylist():
                    if now is None or now.conv_id != r["conv_id"]:
                        if now:
                            out.append(now.close())
                        now, prefix = _Windows(r["conv_id"], budget, history_turns, history_tokens), 0
                    prefix += r["tokens"]
                    out += now.push(r["role"] or "", r["formatted"], r["tokens"], prefix)
                yield pa.RecordBatch.from_pylist(out, schema)
        if now:
            yield pa.RecordBatch.from_pylist([now.close()], schema)

    return counted.mapInArrow(kernel, WINDOW)


def read_back(windows: DataFrame) -> DataFrame:
    """Digest of what the windows hold, per conversation, from formatted text and mask alone.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline for each turn), loss_chars and loss_sha256 (the texts
    under the mask, unescaped, without end marks), formatted_chars, n_windows. Repeated turns are skipped.
    """
    rows = windows.select("conv_id", "window_no", "formatted", "mask", "n_repeated")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "window_no")
    out_schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in out_schema.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        key, state = None, None
        done = lambda: (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5])
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                out = []
                for r in whole.slice(at, 128).to_pylist():
                    if state is None or key != r["conv_id"]:
                        if state:
                            out.append(done())
                        key, state = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                    for role, text, _, _ in parse_turns(r["formatted"])[r["n_repeated"] :]:
                        state[0] += 1
                        state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    for span in r["mask"]:
                        text = unescape(r["formatted"][span["start"] : span["end"]].removesuffix(END))
                        state[2] += len(text)
                        state[3].update(text.encode("utf-8", "surrogatepass"))
                    state[4] += len(r["formatted"])
                    state[5] += 1
                if out:
                    yield pack(out)
        if state:
            yield pack([done()])

    return rows.mapInArrow(kernel, out_schema)


def format_and_read(turns: DataFrame, **options) -> DataFrame:
    return read_back(materialize(chat_windows(turns, **options), "windows"))
