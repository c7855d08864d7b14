"""Vectorised text scanning shared by the operators of this subpackage.

Everything here works on one bounded piece of a batch at a time (``PIECE`` characters or bytes),
so memory does not grow with the batch, and a single text is never cut.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache

import numpy as np

#: Characters (or bytes) handled at once; one longer text makes one longer piece.
PIECE = 1_500_000
#: The same for tokens: arrays of eight bytes a character stay below the size that WORKER_MEMORY maps anew each time.
TOKEN_PIECE = 100_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


#: Bytes of a run that are hashed vectorised; the library hashes longer ones, one by one.
_LANES = 8
_BELOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_KEYS = [np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each run data[start:end] of bytes, independent of its place; with ``second``, another
    one too, which together tell runs apart by 128 bits. Eight bytes at a time go through a bijective
    finaliser that the length keys, so no structure of a run makes two hashes meet."""
    n = ends - starts
    buffer = np.zeros(len(data) + 8, np.uint8)
    buffer[: len(data)] = data
    lanes = np.ndarray(len(data) + 1, "<u8", buffer, strides=(1,))
    h = n.astype(np.uint64) * _KEYS[0] + _KEYS[1]
    g = n.astype(np.uint64) * _KEYS[2] + _KEYS[3] if second else None
    for k in range(_LANES):
        rows = np.flatnonzero(n > 8 * k) if k else slice(None)
        if k and not len(rows):
            break
        v = lanes[starts[rows] + 8 * k] & _BELOW[np.minimum(n[rows] - 8 * k, 8)]
        h[rows] = mix(h[rows] ^ v)
        if second:
            g[rows] = mix((g[rows] + v) * _KEYS[0])
    long = np.flatnonzero(n > 8 * _LANES)
    if len(long):
        import xxhash

        view = memoryview(buffer)
        both = b"".join(xxhash.xxh3_128_digest(view[s:e]) for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True))
        both = np.frombuffer(both, ">u8").reshape(-1, 2).astype(np.uint64)
        h[long] = both[:, 0]
        if second:
            g[long] = both[:, 1]
    return (h, g) if second else h


def pieces(sizes: list[int] | np.ndarray, most: int = PIECE):
    """Ranges (from, to) of consecutive texts of at most ``most`` units together, one text at least."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


#: The white space of the word contracts: space and U+0009 to U+000D.
SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of an Arrow string column; nulls count as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words of consecutive texts start and end in data[offsets[0]:offsets[-1]], and the number in each text."""
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets) - 1, np.int64)
    gap = space[data]
    first = np.empty(len(data), bool)
    first[0] = True
    first[1:] = gap[:-1]
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = gap[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = True
    last[inner - 1] = True
    starts = np.flatnonzero(first & ~gap)
    ends = np.flatnonzero(last & ~gap) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def words(data: np.ndarray, offsets: np.ndarray, second: bool = False) -> tuple:
    """Hashes (with ``second``, two) of the words ``[^\\x20\\x09-\\x0D]+`` of consecutive texts, A-Z as a-z, and
    the number in each text. ``data`` may begin before offsets[0]; the texts must adjoin."""
    starts, ends, counts = spans(data, offsets)
    return run_hashes(LOWER[data[offsets[0] : offsets[-1]]], starts, ends, second), counts


# ---------------------------------------------------------------- tokens

_LETTER, _NUMBER, _OTHER, _WHITE = 1, 2, 3, 0
_WHITE_CHARS = [9, 10, 11, 12, 13, 32, 0x85, 0xA0]
#: Code points whose classes have been stable for long; texts with others are encoded whole.
_KNOWN = 0x0530


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kinds = np.full(_KNOWN, _OTHER, np.uint8)
    for c in range(_KNOWN):
        kind = unicodedata.category(chr(c))
        kinds[c] = _LETTER if kind[0] == "L" else _NUMBER if kind[0] == "N" else _OTHER
        if kind == "Cn":
            kinds[c] = 9  # unassigned: not known
    kinds[_WHITE_CHARS] = _WHITE
    return kinds


@lru_cache(maxsize=1)
def _byte_chars() -> dict[int, str]:
    """Byte-level BPE's printable stand-in of each byte, by its published rule; 0xFF stands for a gap."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in own}
    rest = (b for b in range(256) if b not in table)
    table |= {b: chr(256 + k) for k, b in enumerate(rest)}
    table[0xFF] = " "  # never a byte of UTF-8
    return table


#: Between the pre-tokens that the library's model encodes in one call: a byte that UTF-8 never uses.
_MARK = b"\xff\xc0\xff"


class TokenEncoder:
    """Token ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    The library's model encodes each distinct pre-token once per worker and the ids are gathered from
    there; a pre-token never depends on its neighbours. Pre-tokens are told apart by 128 bits. Texts
    with code points at or above U+0530, or with the string of an added token, are encoded whole by
    the library. The kept table is bounded by ``most`` pre-tokens, then started anew.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.full.no_padding()
        self.full.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        pre = spec.get("pre_tokenizer") or {}
        self.spaced = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.lowered = steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]
        plain = not any(x.get(k) for x in spec.get("added_tokens", []) for k in ("normalized", "single_word", "lstrip", "rstrip"))
        self.fast = plain and ((self.spaced and not spec.get("normalizer")) or self.lowered)
        self.light = Tokenizer(self.full.model)
        self.light.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        got = self.light.encode(_byte_chars()[0xC0], add_special_tokens=False).ids
        self.mark = got[0] if len(got) == 1 else -1
        self.fast = self.fast and self.mark >= 0
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.slots = np.full(1 << 22, -1, np.int32)  # open addressing, linear probing
        self.known = np.zeros((2, self.most + 1), np.uint64)
        self.place = np.zeros(self.most + 1, np.int32)
        self.count = np.zeros(self.most + 1, np.int32)
        self.rows = 0
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts after one another, int32, and each text's number of ids."""
        parts, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for a, b in pieces([len(x) for x in texts], TOKEN_PIECE):
            ids, n = self._piece(texts[a:b])
            parts.append(ids)
            counts.append(n)
        return np.concatenate(parts), np.concatenate(counts)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, np.int32)

    def _normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def _piece(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = {}
        if not self.fast:
            odd = dict(enumerate(map(self._whole, texts)))
        else:
            given, texts = texts, [x if x.isascii() and not self.lowered else self._normal(x) if self.lowered else x for x in texts]
            kinds = _classes()
            for k, x in enumerate(given):
                if any(a in x for a in self.added):
                    odd[k] = self._whole(x)
            if not all(x.isascii() for x in texts):
                for k, x in enumerate(texts):
                    if k not in odd and not x.isascii():
                        c = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
                        if c.max() >= _KNOWN or (kinds[c] == 9).any():
                            odd[k] = self._whole(given[k])
        plain = ["" if k in odd else x for k, x in enumerate(texts)]
        joined = "".join(plain)
        sizes = np.fromiter(map(len, plain), np.int64, len(plain))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        hashes, starts, ends = self._cut(joined, bounds)
        at = self._lookup(joined, hashes, starts, ends)
        lengths = self.count[at].astype(np.int64)
        stops = np.cumsum(lengths)
        total = int(stops[-1]) if len(stops) else 0
        pick = np.ones(total, np.int32)
        if total:
            has = lengths > 0
            where, place, size = (stops - lengths)[has], self.place[at][has], lengths[has]
            pick[where[0]] = place[0]
            pick[where[1:]] = place[1:] - (place[:-1] + size[:-1] - 1)
            np.cumsum(pick, out=pick)
        ids = self.flat[pick]
        ends_of = np.concatenate([[0], stops])[np.searchsorted(starts, bounds)]
        counts = np.diff(ends_of)
        if odd:
            own = np.split(ids, ends_of[1:-1])
            for k, x in odd.items():
                own[k] = x
                counts[k] = len(x)
            ids = np.concatenate(own) if own else ids
        return ids, counts

    def _cut(self, joined: str, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes (two rows), starts and ends of the pre-tokens."""
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(cps)
        if not n:
            none = np.zeros(0, np.int64)
            return np.zeros((2, 0), np.uint64), none, none
        kind = _classes()[cps]
        opening = np.zeros(n + 1, bool)
        opening[bounds] = True
        start = np.empty(n, bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= opening[:-1]
        before = np.empty(n, np.uint8)  # the kind before, 9 at a text's beginning
        before[0] = 9
        before[1:] = kind[:-1]
        before[opening[:-1]] = 9
        quotes = np.flatnonzero((cps == 39) & (before != _OTHER))
        if self.spaced:
            white = kind == _WHITE
            last = np.zeros(n, bool)  # white space before something else of the same text
            last[:-1] = white[:-1] & ~white[1:] & ~opening[1:-1]
            start |= last
            blank = np.flatnonzero(last & (cps == 32))
            start[blank + 1] = False
            quotes = quotes[(quotes == 0) | (cps[quotes - 1] != 32) | opening[quotes]]
        else:
            start |= kind == _NUMBER
        if len(quotes):
            end = bounds[np.searchsorted(bounds, quotes, side="right")]
            at = lambda k: np.where(quotes + k < end, cps[np.minimum(quotes + k, n - 1)], 0)
            c, d = at(1), at(2)
            one = np.isin(c, [ord(x) for x in "stmd"])
            two = ((c == ord("r")) | (c == ord("v"))) & (d == ord("e")) | (c == ord("l")) & (d == ord("l"))
            start[quotes[one | two] + 1] = False
            for hit, k in ((one, 2), (two, 3)):
                after = (quotes + k)[hit]
                start[after[after < n]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], n)
        if not self.spaced:
            keep = kind[starts] != _WHITE
            starts, ends = starts[keep], ends[keep]
        # all code points are below 2**16 here
        return np.stack(run_hashes(cps.astype("<u2").view(np.uint8), 2 * starts, 2 * ends, second=True)), starts, ends

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each pair of hashes in the kept table, -1 where it has none."""
        mask = np.uint64(len(self.slots) - 1)
        slot = (hashes[0] & mask).astype(np.int64)
        row = self.slots[slot]
        left = np.flatnonzero((row >= 0) & (self.known[:, row] != hashes).any(axis=0))
        while len(left):
            slot[left] = (slot[left] + 1) & int(mask)
            row[left] = self.slots[slot[left]]
            left = left[(row[left] >= 0) & (self.known[:, row[left]] != hashes[:, left]).any(axis=0)]
        return row

    def _add(self, hashes: np.ndarray) -> None:
        """Gives new, distinct pairs of hashes the next rows."""
        rows = np.arange(self.rows, self.rows + hashes.shape[1], dtype=np.int32)
        self.known[:, rows] = hashes
        self.rows += len(rows)
        mask = len(self.slots) - 1
        slot = (hashes[0] & np.uint64(mask)).astype(np.int64)
        while len(rows):
            free = np.flatnonzero(self.slots[slot] < 0)
            self.slots[slot[free]] = rows[free]
            left = self.slots[slot] != rows
            rows, slot = rows[left], (slot[left] + 1) & mask

    @staticmethod
    def _distinct(hashes: np.ndarray) -> np.ndarray:
        """Where each distinct pair of hashes comes first."""
        order = np.lexsort((hashes[1], hashes[0]))
        own = hashes[:, order]
        return order[np.append(True, (own[:, 1:] != own[:, :-1]).any(axis=0))] if len(order) else order

    def _lookup(self, joined: str, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The row of each pre-token in the kept table, which gets the new ones first."""
        if self.rows + hashes.shape[1] > self.most:
            own = len(self._distinct(hashes))
            if self.rows + own > self.most:
                most = max(self.most, own)
                self._clear() if most == self.most else self._grow(own)
        at = self._find(hashes)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            first = missing[self._distinct(hashes[:, missing])]
            base = self.rows
            self._add(hashes[:, first])
            for a in range(0, len(first), 10_000):
                part = first[a : a + 10_000]
                raw = _MARK.join(joined[s:e].encode("utf-8", "replace") for s, e in zip(starts[part].tolist(), ends[part].tolist(), strict=True)) + _MARK
                ids = np.array(self.light.encode_batch_fast([raw.decode("latin-1").translate(_byte_chars())], add_special_tokens=False)[0].ids, np.int32)
                marks = np.flatnonzero(ids == self.mark)
                if len(marks) != len(part):
                    raise ValueError("the vocabulary has no id for a byte that UTF-8 never uses")
                n = np.diff(marks, prepend=-1) - 1
                ids = ids[ids != self.mark]
                while self.used + len(ids) > len(self.flat):
                    self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
                self.flat[self.used : self.used + len(ids)] = ids
                rows = slice(base + a, base + a + len(part))
                self.place[rows] = self.used + np.cumsum(n) - n
                self.count[rows] = n
                self.used += len(ids)
            at[missing] = self._find(hashes[:, missing])
        return at

    def _grow(self, most: int) -> None:
        """For one text with more pre-tokens than the bound."""
        kept, self.most = self.most, most
        self._clear()
        while len(self.slots) < 2 * most:
            self.slots = np.full(2 * len(self.slots), -1, np.int32)
        self.most = kept  # the next piece starts anew


@lru_cache(maxsize=4)
def encoder(path: str) -> TokenEncoder:
    """One encoder for each vocabulary file and Python worker; it serves all tasks of the worker."""
    return TokenEncoder(path)
