"""Static range asymmetric numeral system over token ids, in independent blocks of interleaved lanes.

State x is 64 bits, renormalised by 32-bit words: 2**31 <= x < 2**63. Frequencies sum to 2**SCALE.
A block: header, per-document ids and lengths, checkpoints (word position and every lane's state before
a step), words, each part under a CRC-32. Lane j of a block holds ids j, j + lanes, j + 2 lanes, ...
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 20
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sIIIIIIQII")
_MAGIC = b"MSR1"


class Table:
    """Shared frequencies: symbols that occur get at least 1 of 2**SCALE, in proportion to their counts."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64) if len(freq) else self.freq
        self.total = int(self.freq.sum())
        self._slots = None

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        counts = counts.astype(np.int64)
        has = counts > 0
        if not has.any():
            return cls(np.zeros(len(counts), np.int64))
        room, total = 1 << SCALE, int(counts.sum())
        if has.sum() > room:
            raise ValueError(f"more than {room} symbols")
        freq = np.where(has, np.maximum(1, counts.astype(np.float64) * (room / total)).astype(np.int64), 0)
        over = int(freq.sum()) - room
        order = np.lexsort((np.arange(len(freq)), -freq))  # the most frequent take the rounding
        k = 0
        while over:
            i = order[k % len(order)]
            step = min(over, max(1, int(freq[i]) // 8), int(freq[i]) - 1) if over > 0 else over
            freq[i] -= step
            over -= step
            k += 1
        return cls(freq)

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.int32), self.freq.astype(np.int64))
        return self._slots


def encode(ids: np.ndarray, table: Table, lanes: int = 1024, every: int = 128) -> tuple[bytes, int]:
    """The coded part of a block, and its number of lanes. every: steps between checkpoints."""
    n = len(ids)
    lanes = max(1, min(lanes, n // 64))
    steps = -(-n // lanes)
    freq, cum = table.freq[ids], table.cum[ids]
    if n and not freq.all():
        raise ValueError("an id has no frequency")
    x = np.full(lanes, _LOW, np.uint64)
    out: list[np.ndarray] = [None] * steps
    marks = {}
    scale, limit, word = np.uint64(SCALE), np.uint64(63 - SCALE), np.uint64(32)
    for t in range(steps - 1, -1, -1):
        a, b = t * lanes, min((t + 1) * lanes, n)
        f, c = freq[a:b], cum[a:b]
        own = x[: b - a]
        spill = own >= (f << limit)
        out[t] = own[spill].astype("<u4")
        own = np.where(spill, own >> word, own)
        q = own // f
        x[: b - a] = (q << scale) + (own - q * f) + c
        if t % every == 0:
            marks[t] = x.copy()
    at = np.concatenate([[0], np.cumsum([len(w) for w in out])]) if steps else np.zeros(1, np.int64)
    points = b"".join(struct.pack("<II", t, int(at[t])) + marks[t].astype("<u8").tobytes() for t in sorted(marks))
    body = b"".join(w.tobytes() for w in out)
    return struct.pack("<III", lanes, len(marks), len(body) // 4) + points + body, lanes


def decode(coded: bytes, n: int, table: Table, point: int = 0) -> np.ndarray:
    """The ids of a coded part, from checkpoint ``point`` on."""
    lanes, count, words = struct.unpack_from("<III", coded)
    if not n:
        return np.zeros(0, np.int32)
    size = 8 + 8 * lanes
    t0, at = struct.unpack_from("<II", coded, 12 + point * size)
    x = np.frombuffer(coded, "<u8", lanes, 12 + point * size + 8).astype(np.uint64)
    stream = np.frombuffer(coded, "<u4", words, 12 + count * size)
    ids = np.empty(n - t0 * lanes, np.int32)
    slots, freq, cum = table.slots, table.freq, table.cum
    scale, mask, word = np.uint64(SCALE), np.uint64((1 << SCALE) - 1), np.uint64(32)
    for t in range(t0, -(-n // lanes)):
        a, b = t * lanes, min((t + 1) * lanes, n)
        own = x[: b - a]
        slot = own & mask
        s = slots[slot]
        ids[a - t0 * lanes : b - t0 * lanes] = s
        own = freq[s] * (own >> scale) + slot - cum[s]
        need = np.flatnonzero(own < _LOW)
        if len(need):
            own[need] = (own[need] << word) | stream[at : at + len(need)]
            at += len(need)
        x[: b - a] = own
    return ids


def write_block(ids: np.ndarray, doc_ids: list[int | None], sizes: np.ndarray, start: int, table: Table) -> bytes:
    """One self-contained block of whole documents; start: number of ids before it in the file."""
    coded, _ = encode(ids, table)
    known = np.array([x is not None for x in doc_ids], np.uint8).tobytes()
    index = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + sizes.astype("<u4").tobytes() + known
    head = _HEAD.pack(_MAGIC, len(ids), len(doc_ids), len(index), len(coded), table.total, zlib.crc32(index), start, zlib.crc32(coded), zlib.crc32(ids.astype("<u4").tobytes()))
    return head + struct.pack("<I", zlib.crc32(head)) + index + coded


def read_block(block: bytes, table: Table) -> tuple[np.ndarray, list[int | None], np.ndarray, int]:
    """(ids, doc_ids, sizes, start); raises ValueError if a checksum fails."""
    magic, n, docs, index_size, coded_size, total, index_crc, start, coded_crc, ids_crc = _HEAD.unpack_from(block)
    at = _HEAD.size + 4
    index, coded = block[at : at + index_size], block[at + index_size : at + index_size + coded_size]
    if magic != _MAGIC or struct.unpack_from("<I", block, _HEAD.size)[0] != zlib.crc32(block[: _HEAD.size]) or total != table.total or zlib.crc32(index) != index_crc or zlib.crc32(coded) != coded_crc:
        raise ValueError("a damaged block")
    ids = decode(coded, n, table)
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("a block decoded to other ids")
    known = np.frombuffer(index, np.uint8, docs, 12 * docs)
    doc_ids = [x if k else None for x, k in zip(np.frombuffer(index, "<i8", docs).tolist(), known.tolist(), strict=True)]
    return ids, doc_ids, np.frombuffer(index, "<u4", docs, 8 * docs).astype(np.int64), start
