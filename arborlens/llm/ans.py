"""Static range asymmetric numeral system over token ids: one table of frequencies, blocks of interleaved lanes that
decode by themselves, checkpoints inside a block, and checksums.

A block of n ids is dealt to `lanes` coders in turn, which share one stream of 32-bit words: at each step every lane
codes one id. A coder's state x lies in [2^31, 2^63); frequencies add up to 2^bits. Coding runs from the last step to
the first, so that decoding runs forward; at every `every`-th step the states and the place in the stream are kept as a
checkpoint, from which decoding can begin. All numbers are little-endian.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LOW = np.uint64(1 << 31)
_HEAD = "<4sIHHIIIII"
MAGIC = b"RAN1"


def quantize(counts: np.ndarray, bits: int = 18) -> np.ndarray:
    """Frequencies that add up to 2^bits, at least 1 where counts are not 0; the largest take up what rounding leaves."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(len(counts), np.uint32)
    there = counts > 0
    if int(there.sum()) > 1 << bits:
        raise ValueError(f"{int(there.sum())} ids do not fit {bits} bits")
    freq = np.where(there, np.maximum(np.floor(counts * (float(1 << bits) / total)), 1), 0).astype(np.int64)
    order = np.lexsort((np.arange(len(freq)), -freq))
    rest = (1 << bits) - int(freq.sum())
    if rest > 0:
        freq[order[0]] += rest
    while rest < 0:  # take from the largest what the smallest got by rounding up
        for k in order[: max(1, int(there.sum()))]:
            less = min(-rest, max(0, int(freq[k]) - max(1, int(freq[k]) // 2)))
            freq[k] -= less
            rest += less
            if rest == 0:
                break
    return freq.astype(np.uint32)


class Table:
    def __init__(self, freq: np.ndarray, bits: int):
        self.bits, self.freq = bits, freq.astype(np.uint64)
        self.low = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())
        self._ids: np.ndarray | None = None

    @property
    def ids(self) -> np.ndarray:
        """The id of every slot."""
        if self._ids is None:
            self._ids = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._ids


def encode_block(ids: np.ndarray, table: Table, lanes: int = 256, every: int = 128) -> bytes:
    return encode_blocks([ids], table, lanes, every)[0]


def encode_blocks(blocks: list[np.ndarray], table: Table, lanes: int = 256, every: int = 128) -> list[bytes]:
    """Blocks of one number of ids, side by side; each is coded as if by itself."""
    n, bits, room, shift = len(blocks[0]), np.uint64(table.bits), np.uint64(63 - table.bits), np.uint64(32)
    steps = -(-n // lanes)
    if n and not all(table.freq[ids].all() for ids in blocks):
        raise ValueError("an id without a frequency")
    dealt = np.zeros((len(blocks), steps * lanes), np.uint32)
    for k, ids in enumerate(blocks):
        dealt[k, :n] = ids
    dealt = dealt.reshape(len(blocks), steps, lanes).swapaxes(0, 1)
    x = np.full((len(blocks), lanes), LOW, np.uint64)
    words, over, kept = np.empty(dealt.shape, np.uint32), np.zeros(dealt.shape, bool), []
    for s in range(steps - 1, -1, -1):
        m = min(n - s * lanes, lanes)
        own, at = dealt[s, :, :m], x[:, :m]
        f = table.freq[own]
        full = np.greater_equal(at, f << room, out=over[s, :, :m])
        words[s, :, :m] = at  # the lower 32 bits
        at = np.where(full, at >> shift, at)
        q = at // f
        x[:, :m] = (q << bits) + (at - q * f) + table.low[own]
        if s % every == 0:
            kept.append(x.copy())
    out = []
    for k, ids in enumerate(blocks):
        stream = words[:, k][over[:, k]]
        before = (np.cumsum(over[:, k].sum(1)) - over[:, k].sum(1))[::every]
        raw = ids.astype("<u4")
        checks = [zlib.crc32(raw[i * every * lanes : (i + 1) * every * lanes].tobytes()) for i in range(len(kept))]
        head = struct.pack(_HEAD, MAGIC, n, lanes, table.bits, every, len(kept), len(stream), table.crc, zlib.crc32(raw.tobytes()))
        states = np.concatenate([x[k] for x in kept[::-1]]) if kept else np.zeros(0, np.uint64)
        body = head + before.astype("<u4").tobytes() + np.array(checks, "<u4").tobytes() + states.astype("<u8").tobytes() + stream.astype("<u4").tobytes()
        out.append(body + struct.pack("<I", zlib.crc32(body)))
    return out


def segments(data: bytes) -> int:
    """Checkpoints of a block: each begins a segment that decodes by itself."""
    return struct.unpack_from(_HEAD, data)[5]


def segment_ids(data: bytes) -> int:
    """ids of each segment of a block but the last."""
    _, _, lanes, _, every, *_ = struct.unpack_from(_HEAD, data)
    return lanes * every


def decode_block(data: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """ids of a block, or of its segments first to last - 1. Raises ValueError where a checksum does not hold."""
    magic, n, lanes, bits, every, points, count, crc, whole = struct.unpack_from(_HEAD, data)
    if magic != MAGIC or bits != table.bits or crc != table.crc:
        raise ValueError("not a block of this table")
    if zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("a block's checksum does not hold")
    last = points if last is None else min(last, points)
    at = struct.calcsize(_HEAD)
    before = np.frombuffer(data, "<u4", points, at)
    checks = np.frombuffer(data, "<u4", points, at + 4 * points)
    states = np.frombuffer(data, "<u8", points * lanes, at + 8 * points).reshape(points, lanes)
    stream = np.frombuffer(data, "<u4", count, at + 8 * points + 8 * points * lanes)
    if first >= last:
        return np.zeros(0, np.uint32)
    begin, end = first * every * lanes, min(n, last * every * lanes)
    # segments side by side; only the last may have fewer steps, the last of them for fewer lanes
    some, steps = last - first, -(-(end - begin) // lanes) - (last - first - 1) * every
    out = np.empty((some, every, lanes), np.uint32)
    x, place, starts = states[first:last].astype(np.uint64).reshape(-1), before[first:last].astype(np.int64), np.arange(some + 1) * lanes
    mask, shift, b, slots = np.uint64((1 << bits) - 1), np.uint64(32), np.uint64(bits), table.ids
    for s in range(every if some > 1 else steps):
        m = (some - (s >= steps)) * lanes if s != steps - 1 else end - begin - (some - 1) * every * lanes - s * lanes + (some - 1) * lanes
        at = x[:m]
        slot = at & mask
        got = slots[slot]
        whole = m // lanes
        out[:whole, s] = got[: whole * lanes].reshape(whole, lanes)
        if m % lanes:
            out[whole, s, : m % lanes] = got[whole * lanes :]
        at = table.freq[got] * (at >> b) + slot - table.low[got]
        short = np.flatnonzero(at < LOW)
        bounds = np.searchsorted(short, starts)
        taken = np.diff(bounds)
        at[short] = (at[short] << shift) | stream[np.arange(len(short)) + np.repeat(place - bounds[:-1], taken)]
        place += taken
        x[:m] = at
    out = out.reshape(-1)[: end - begin]
    size = every * lanes
    for k in range(first, last):
        if zlib.crc32(out[k * size - begin : (k + 1) * size - begin].astype("<u4").tobytes()) != checks[k]:
            raise ValueError("a segment's checksum does not hold")
    return out
