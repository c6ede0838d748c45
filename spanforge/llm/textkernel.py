"""Vectorised word and n-gram hashing over the UTF-8 buffers of Arrow string arrays.

Everything here works on whole texts, a block of documents at a time, without a Python loop over words.  The
tokens of a text are maximal runs of letters, digits and underscores (any non-ASCII character that isn't general
punctuation or a Latin-1 sign counts as a letter); characters of U+3000..U+9FFF are tokens of their own, since their
scripts put no blanks between words.  Case is folded first.  Null texts have no tokens.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of text that are handled at once; a longer document makes a block of its own.
BLOCK_BYTES = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95]] = True
_WORD[128:] = True

_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def pack(values: np.ndarray) -> bytes:
    """Integers from 0 on: as many bytes of each as the largest needs, byte by byte, compressed."""
    v = values.astype("<u8")
    width = max(1, (int(v.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return struct.pack("<QB", len(v), width) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<QB", data)
    planes = np.frombuffer(pa.decompress(data[9:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending integers, by their differences."""
    v = values.astype(np.uint64)
    return pack(np.append(v[:1], np.diff(v)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        tables = []
        for factor in (_BASE, _INV):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers[:] = tables
    return _powers[0], _powers[1]


class Block:
    """Some documents of a batch: rows first..last (exclusive), their folded bytes and document offsets."""

    def __init__(self, first: int, last: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.last, self.data, self.offsets = first, last, data, offsets
        self._prefix: np.ndarray | None = None

    @property
    def n_docs(self) -> int:
        return self.last - self.first

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of the tokens, and the document number (within the block) of each."""
        b = self.data
        if not len(b):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        word = _WORD[b]
        lead = b >= 0xC2
        wide = None
        if lead.any():
            two = np.flatnonzero(b[:-1] == 0xC2)  # Latin-1 signs and no-break space; the letters ª µ º stay
            two = two[~np.isin(b[two + 1], (0xAA, 0xB5, 0xBA))]
            word[two] = word[two + 1] = False
            three = np.flatnonzero(b[:-2] == 0xE2)
            three = three[(b[three + 1] == 0x80) | (b[three + 1] == 0x81)]  # dashes, quotes, blanks
            sep = np.flatnonzero((b[:-2] == 0xE3) & (b[1:-1] == 0x80)) if len(b) > 2 else three[:0]
            sep = sep[b[sep + 2] <= 0xBF]
            for k in range(3):
                word[three + k] = False
                word[sep + k] = False
            wide = np.flatnonzero((b >= 0xE3) & (b <= 0xE9) & word)
        before = np.empty_like(word)
        before[0] = False
        before[1:] = word[:-1]
        start = word & ~before
        cut = self.offsets[:-1]
        cut = cut[cut < len(b)]
        start[cut] |= word[cut]
        if wide is not None and len(wide):
            start[wide] = True
            after = wide + 3
            after = after[after < len(b)]
            start[after] |= word[after]
        starts = np.flatnonzero(start)
        # a token ends at the next separator or at the next start, whichever comes first
        stop = before & ~word
        stop[starts] |= before[starts]
        ends = np.flatnonzero(stop)
        if len(ends) < len(starts):
            ends = np.append(ends, len(b))
        docs = np.searchsorted(self.offsets, starts, side="right") - 1
        return starts, ends, docs

    def prefix_hash(self) -> np.ndarray:
        if self._prefix is None:
            power, _ = _power_tables(len(self.data) + 1)
            out = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[: len(self.data)], out=out[1:])
            self._prefix = out
        return self._prefix

    def hash_ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte ranges; the same bytes have the same hash wherever they stand."""
        p = self.prefix_hash()
        _, inverse = _power_tables(len(self.data) + 1)
        return mix64((p[ends] - p[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def blocks(texts: pa.Array | pa.ChunkedArray, fold: bool = True) -> Iterator[Block]:
    """Cuts a string array into blocks of whole documents."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if fold:
        texts = pc.utf8_lower(texts)
    n = len(texts)
    if not n:
        return
    bufs = texts.buffers()
    offsets = np.frombuffer(bufs[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, side="right")) - 1
        last = min(max(last, first + 1), n)
        lo, hi = int(offsets[first]), int(offsets[last])
        yield Block(first, last, data[lo:hi], offsets[first : last + 1] - lo)
        first = last


def ngram_hashes(words: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside one document, and their document numbers (in order)."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(words) - n + 1
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = (h ^ words[k : k + m]) * _M2
        h ^= h >> np.uint64(29)
    inside = docs[:m] == docs[n - 1 :]
    return mix64(h[inside]), docs[:m][inside]
