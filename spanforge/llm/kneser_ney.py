"""Perplexity under an interpolated modified Kneser-Ney model of order 3 or more, counted over the whole corpus.

1. The words of all documents are counted and numbered, the frequent ones first (by powers of two of their counts), so that
   n-grams are short lists of small numbers.
2. A group of documents sends its distinct n-grams of the highest order with their counts, sorted and compressed by column, to the
   bucket of their context (of the whole n-gram where all words of the context are among the `HOT` ones, as such contexts have very
   many successors).  There the counts are added up and the bucket's part of the model is written: hashes of n-grams with counts,
   and for each context its total and how many successors it has with counts of 1, 2 and 3 or more.  Each different n-gram counts
   once for the n-gram without its first word, whose order is written in the same way after one more shuffle, and so on down to
   the words.  What is known of a hot context in several buckets is added up with the next order.
3. The files lie in the shared folder as sorted arrays: hashes in segments of about 64, of which the low 32 bits are stored, and
   a byte for the count (or what is known of a context) with a list of the rare ones.  Those of neighbouring buckets are joined, as
   a worker holds as many files open, and searches as many, as there are.  Workers map them into memory and look up hashes by binary
   search.  (Of n-grams that differ about one in 10**8 shares a slot with another.)

    p(w|h) = max(c(hw) - D(c), 0) / c(h) + g(h) p(w|h'),   g(h) = (D1 N1(h) + D2 N2(h) + D3 N3(h)) / c(h)
    p(w)   = max(n(w) - D'(n), 0) / N + g' / (V + 1)

h' is h without its first word.  c are counts at the highest order, and numbers of different words before the n-gram at the orders
below; n(w) are numbers of different words before w, N their sum, V the number of words; D1, D2, D3 of each order come from the
numbers of its n-grams that have the counts 1 to 4.  A document is one sequence between begin marks (one less than the order) and an
end mark.

A document is scored by the counts of all other documents: its own are taken off, and where an n-gram was only in it, so is what
that n-gram counts for at the order below.  The discounts and V stay those of the whole corpus.  So a text that is there once
isn't predicted from itself, and a text that is there twice is.

Defined cases: null and empty texts and texts without words have n_tokens 0, log_prob 0 and no perplexity, and don't count
in the model; null ids are scored; rows that repeat are counted and scored each; words that the model has not seen get the
share of unknown words; an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

import os
import pickle
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import bucket_count, shared_path, ship
from spanforge.llm.textkernel import blocks, mix64, pack, pack_sorted, unpack, unpack_sorted

#: Words of the longest n-grams.
ORDER = 3
#: Bytes of text whose n-grams are counted together, and those whose n-grams are looked up together.
GROUP_TEXT, SCORE_TEXT = 12 << 20, 3 << 20
#: Words of text whose n-grams go to a bucket of their own.
BUCKET_WORDS = 2_000_000
#: Files that the buckets of a table are joined in; more where one would have more than `PART_BUCKETS`.
PARTS, PART_BUCKETS = 16, 256
#: Words that occur at least 2**HOT times make hot contexts.
HOT = 20
#: Numbers that aren't words.
BEGIN, END, UNKNOWN, WORDS = 0, 1, 2, 3
#: Entries of a segment, as far as hashing spreads them evenly.
SEGMENT = 64
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_32 = np.uint64(32)


def groups(batch: pa.RecordBatch, column: int, text: int = GROUP_TEXT) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, hashes of the words, row of each word from the first) of groups of documents."""
    words, docs, low, size, last = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0, 0, 0
    for block in blocks(batch.column(column)):
        starts, ends, d = block.words()
        words.append(block.hash_ranges(starts, ends))
        docs.append(d + block.first - low)
        size, last = size + len(block.data), block.last
        if size >= text:
            yield low, last, np.concatenate(words), np.concatenate(docs)
            words, docs, low, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], last, 0
    if last > low:
        yield low, last, np.concatenate(words), np.concatenate(docs)


def sequences(words: np.ndarray, docs: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The n-grams that end at each word and at each end mark, as columns of numbers, and the document of each."""
    if not len(words):
        return [np.zeros(0, np.int64)] * order, np.zeros(0, np.int64)
    new = np.append(True, docs[1:] != docs[:-1])
    last = np.append(np.flatnonzero(new)[1:], len(words)) - 1
    place = np.arange(len(words)) + np.cumsum(new) - 1  # end marks stand between the documents
    n = len(words) + len(last)
    line, doc = np.full(n, END, np.int64), np.zeros(n, np.int64)
    line[place], doc[place] = words, docs
    doc[place[last] + 1] = docs[last]
    begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    offset = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    columns = [line]
    for back in range(1, order):
        earlier = np.full(n, BEGIN, np.int64)
        earlier[back:] = np.where(offset[back:] >= back, line[: max(n - back, 0)], BEGIN)
        columns.append(earlier)
    return columns[::-1], doc


def _longer(h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return mix64((h + _GOLDEN) ^ mix64(ids.astype(np.uint64) * _GOLDEN))


def hashes(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the contexts and of the whole n-grams."""
    h = np.full(len(columns[-1]), len(columns), np.uint64)
    for c in columns[:-1]:
        h = _longer(h, c)
    return h, _longer(h, columns[-1])


def is_hot(columns: list[np.ndarray], limit: int) -> np.ndarray:
    """Whether all words of the context are hot (of single words the context is)."""
    out = np.ones(len(columns[-1]), bool)
    for c in columns[:-1]:
        out &= c < limit
    return out


def bucket_of(h: np.ndarray, n_buckets: int) -> np.ndarray:
    """At most 2**16 buckets."""
    return (((h >> np.uint64(48)) * np.uint64(n_buckets)) >> np.uint64(16)).astype(np.int64)


def gram_buckets(columns: list[np.ndarray], limit: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of contexts and n-grams, whether contexts are hot, buckets."""
    context, gram = hashes(columns)
    hot = is_hot(columns, limit)
    return context, gram, hot, bucket_of(np.where(hot, gram, context), n_buckets)


def _order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by the columns."""
    bits = [max(1, int(c.max(initial=0)).bit_length()) for c in columns]
    over = max(0, sum(bits) - 64)
    if over >= bits[-1]:
        return np.lexsort(columns[::-1])
    key = np.zeros(len(columns[0]), np.uint64)
    for c, b in zip(columns[:-1], bits):
        key = (key << np.uint64(b)) | c.astype(np.uint64)
    key = (key << np.uint64(bits[-1] - over)) | (columns[-1].astype(np.uint64) >> np.uint64(over))
    by = np.argsort(key)
    if over:  # rows that differ in the last bits alone
        key, last = key[by], columns[-1][by]
        same = key[1:] == key[:-1]
        run = np.cumsum(np.append(0, ~same))
        mixed = np.zeros(len(by), bool)
        mixed[run[1:][same & (last[1:] != last[:-1])]] = True
        at = np.flatnonzero(mixed[run])
        by[at] = by[at][np.lexsort((last[at], run[at]))]
    return by


def sum_equal(columns: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows in order, with the sums of their values."""
    if not len(columns[0]):
        return columns, values
    by = _order(columns)
    columns = [c[by] for c in columns]
    new = np.zeros(len(by), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return [c[at] for c in columns], [np.add.reduceat(v[by], at) for v in values]


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values, where one of each is, which of them each element is, and how often each is there; faster than by a
    stable sort, which numpy's own takes."""
    by = np.argsort(x)
    x = x.take(by)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(x)))
    inverse = np.empty(len(x), np.int64)
    inverse[by] = np.repeat(np.arange(len(at)), times)
    return x.take(at), by.take(at), inverse, times


def _tell(counts: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3 and 4, how many 3 or more, how many at all, and their sum."""
    return np.array([*((counts == k).sum() for k in (1, 2, 3, 4)), (counts >= 3).sum(), len(counts), counts.sum()], np.int64)


# files


def _write(path: str, arrays: dict[str, tuple[np.dtype, tuple[int, ...], Iterator[np.ndarray]]]) -> None:
    """A file of arrays, each given by its type, its shape and its pieces.  Attempts of a task write the same file; the last one to end
    stays."""
    head, at = {}, 0
    for name, (kind, shape, _) in arrays.items():
        head[name] = np.dtype(kind).str, shape, at
        at += -(-np.dtype(kind).itemsize * int(np.prod(shape)) // 64) * 64
    told = pickle.dumps(head, 5)
    start = -(-(8 + len(told)) // 64) * 64
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        f.write(len(told).to_bytes(8, "little") + told)
        for name, (kind, _, pieces) in arrays.items():
            f.seek(start + head[name][2])
            for x in pieces:
                f.write(np.ascontiguousarray(x, kind).data)
        f.truncate(start + at)
    os.replace(part, path)


def _save(path: str, **arrays: np.ndarray) -> None:
    _write(path, {name: (x.dtype, x.shape, iter([x])) for name, x in arrays.items()})


def _arrays(path: str) -> dict[str, tuple[np.dtype, tuple[int, ...], int]]:
    """Types, shapes and places of a file's arrays."""
    with open(path, "rb") as f:
        size = int.from_bytes(f.read(8), "little")
        start = -(-(8 + size) // 64) * 64
        return {name: (np.dtype(kind), shape, start + at) for name, (kind, shape, at) in pickle.loads(f.read(size)).items()}


def _read(path: str, name: str) -> np.ndarray:
    kind, shape, at = _arrays(path)[name]
    return np.fromfile(path, kind, int(np.prod(shape)), offset=at).reshape(shape)


def part_count(n_buckets: int) -> int:
    return min(n_buckets, max(PARTS, -(-n_buckets // PART_BUCKETS)))


def part_of(bucket: np.ndarray, n_buckets: int) -> np.ndarray:
    """Neighbouring buckets are in the same part."""
    return bucket * part_count(n_buckets) // n_buckets


def _join(path: str, table: str, n_buckets: int, part: int, write: Callable[[str, list[str], list[int]], None]) -> None:
    """Writes one file of the files of a part's buckets, which are deleted, by `write` (file, files of buckets that have one, buckets).
    As a file is there before the first of those that it is made of is deleted, an attempt that finds no such file has all of them."""
    numbers = np.flatnonzero(part_of(np.arange(n_buckets), n_buckets) == part).tolist()
    target, names = f"{path}/{table}.{part:05d}", [f"{path}/{table}-{b:05d}" for b in numbers]
    found = [x if os.path.exists(x) else "" for x in names]
    if any(found) and not os.path.exists(target):
        try:
            write(target, found, numbers)
        except FileNotFoundError:
            if not os.path.exists(target):
                raise
    for x in names:
        with suppress(FileNotFoundError):
            os.remove(x)


def _segments(h: np.ndarray, n: np.ndarray | np.uint64) -> np.ndarray:
    return (((h >> _32) & np.uint64(0xFFFFFF)) * n) >> np.uint64(24)


def _context_codes() -> tuple[np.ndarray, np.ndarray]:
    """The frequent rows (total, n1, n2, n3) of contexts by code, and codes by total, n1, n2 and n3 (4 bits each); 255 is none."""
    rows = [
        (n1 + 2 * n2 + above, n1, n2, n3)
        for n1 in range(16) for n2 in range(8) for n3 in range(6) for above in (range(3 * n3, 16) if n3 else (0,)) if 0 < n1 + 2 * n2 + above < 16
    ]
    rows = sorted(rows)[:255]
    codes = np.full(1 << 16, 255, np.uint8)
    decoded = np.zeros((256, 4), np.int64)
    for k, (total, n1, n2, n3) in enumerate(rows):
        codes[total << 12 | n1 << 8 | n2 << 4 | n3] = k
        decoded[k] = total, n1, n2, n3
    return decoded, codes


_CONTEXTS, _CONTEXT_CODES = _context_codes()
#: The code of a hash that isn't there.
_NONE = 256
_DECODED = {k: np.ascontiguousarray(np.append(x, np.zeros((1, k), np.int64), axis=0).T) for k, x in ((1, np.arange(256)[:, None]), (4, _CONTEXTS))}


def save_table(path: str, h: np.ndarray, values: list[np.ndarray]) -> None:
    """A table of rows of numbers by hash: counts, or what is known of contexts.  Frequent rows take a byte."""
    n = max(1, len(h) // SEGMENT)
    key = (_segments(h, np.uint64(n)) << _32) | (h & np.uint64(0xFFFFFFFF))
    by = np.argsort(key)
    key = key[by]
    offsets = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << _32).astype(np.uint32)
    rows = np.stack([v[by] for v in values])
    if len(values) == 1:
        code = np.minimum(rows[0], 255).astype(np.uint8)
    else:
        small = (rows < 16).all(axis=0)
        code = np.full(len(h), 255, np.uint8)
        code[small] = _CONTEXT_CODES[rows[0, small] << 12 | rows[1, small] << 8 | rows[2, small] << 4 | rows[3, small]]
    rare = np.flatnonzero(code == 255)
    rows = rows[:, rare].T.astype(np.int64)
    _save(path, low=key.astype(np.uint32), offsets=offsets, code=code, at=rare.astype(np.uint32), rare=rows, first=np.zeros(1, np.int64), segments=np.array([0, n]))


def join_tables(target: str, names: list[str], numbers: list[int]) -> None:
    """One table of those of some buckets ("" where there is none), with the first segment of each."""
    shapes = [{k: v[1] for k, v in _arrays(x).items()} if x else {"low": (0,), "offsets": (2,), "at": (0,), "rare": (0, 0)} for x in names]
    entries, segments, rare = (np.cumsum([0, *(x[k][0] - less for x in shapes)]) for k, less in (("low", 0), ("offsets", 1), ("at", 0)))
    width = max(x["rare"][1] for x in shapes)
    kind = np.uint32 if entries[-1] < 1 << 32 else np.int64
    there = [(x, n) for x, n in zip(names, entries) if x]

    def offsets() -> Iterator[np.ndarray]:
        for x, n in zip(names, entries):
            yield (_read(x, "offsets")[:-1] if x else np.zeros(1, np.int64)) + np.int64(n)
        yield entries[-1:]

    arrays = {
        "low": (np.uint32, (int(entries[-1]),), (_read(x, "low") for x, _ in there)),
        "offsets": (kind, (int(segments[-1]) + 1,), offsets()),
        "code": (np.uint8, (int(entries[-1]),), (_read(x, "code") for x, _ in there)),
        "at": (kind, (int(rare[-1]),), (_read(x, "at") + np.int64(n) for x, n in there)),
        "rare": (np.int64, (int(rare[-1]), width), (_read(x, "rare") for x, _ in there)),
        "first": (np.int64, (1,), iter([np.array(numbers[:1])])),
        "segments": (np.int64, (len(segments),), iter([segments])),
    }
    _write(target, arrays)


_maps: dict[str, dict[str, np.ndarray] | None] = {}


def _map(path: str) -> dict[str, np.ndarray] | None:
    """The arrays of a file of the model, mapped into memory once per worker."""
    if path not in _maps:
        _maps[path] = None
        if os.path.exists(path):
            data = np.memmap(path, np.uint8, "r").view(np.ndarray)
            _maps[path] = {k: np.ndarray(shape, kind, data, at) for k, (kind, shape, at) in _arrays(path).items()}
    return _maps[path]


def _codes(path: str, h: np.ndarray, bucket: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of hashes in their buckets, which are the rare ones, and the rows of these."""
    stored = _map(path)
    if stored is None or not len(stored["low"]):
        return np.full(len(h), _NONE, np.uint16), np.zeros(0, np.int64), np.zeros((0, 0), np.int64)
    low, offsets, segments = stored["low"], stored["offsets"], stored["segments"]
    b = bucket - stored["first"][0]
    segment = _segments(h, np.diff(segments).astype(np.uint64).take(b))
    segment += segments.astype(np.uint64).take(b)
    key, _, which, _ = distinct((segment << _32) | (h & np.uint64(0xFFFFFFFF)))  # neighbours lie together
    segment, wanted = (key >> _32).astype(np.int64), key.astype(np.uint32)
    a, end = offsets.take(segment).astype(np.int64), offsets.take(segment + 1).astype(np.int64)
    # the place of the last smaller one, or the place before the segment
    place, last = a - 1, end - 1
    step = 1 << max(0, int((end - a).max()).bit_length() - 1)
    while step:
        to = np.minimum(place + step, last)
        place = np.where(low.take(to, mode="clip") < wanted, np.maximum(to, place), place)
        step >>= 1
    place += 1
    hit = np.flatnonzero(place < end)
    hit = hit[low.take(place.take(hit)) == wanted.take(hit)]
    code = np.full(len(key), _NONE, np.uint16)
    code[hit] = stored["code"].take(place.take(hit))
    over = np.flatnonzero(code == 255)
    rows = stored["rare"].take(np.searchsorted(stored["at"], place.take(over)), axis=0)
    place[over] = np.arange(len(over))
    code = code.take(which)
    over = np.flatnonzero(code == 255)
    return code, over, rows.take(place.take(which.take(over)), axis=0)


def _decode(code: np.ndarray, rare: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    out = np.stack([x.take(code) for x in _DECODED[width]])
    for at, rows in rare:
        out[:, at] = rows.T
    return out


def look_up(path: str, h: np.ndarray, width: int, bucket: np.ndarray | int = 0) -> np.ndarray:
    """The rows of hashes in their buckets (0 in a file of one bucket), `width` numbers each, 0 where there is none."""
    code, over, rows = _codes(path, h, bucket)
    return _decode(code, [(over, rows)] if len(over) else [], width)


# words


@dataclass
class Vocabulary:
    """Numbers of words.  base: the number of the first word of each class of frequency (powers of two) in each bucket."""

    path: str
    n_buckets: int
    base: np.ndarray
    hot_limit: int

    def ids(self, h: np.ndarray) -> np.ndarray:
        word, _, inverse, _ = distinct(h)
        out = np.full(len(word), UNKNOWN, np.int64)
        cut = np.searchsorted(part_of(bucket_of(word, self.n_buckets), self.n_buckets), np.arange(part_count(self.n_buckets) + 1))
        for p in np.flatnonzero(np.diff(cut)):
            stored = _map(os.path.join(self.path, f"words.{p:05d}"))
            if stored is None:
                continue
            w = word[cut[p] : cut[p + 1]]
            at = np.minimum(np.searchsorted(stored["hash"], w), len(stored["hash"]) - 1)
            out[cut[p] : cut[p + 1]] = np.where(stored["hash"][at] == w, stored["id"][at], UNKNOWN)
        return out[inverse]

    def join(self, target: str, names: list[str], numbers: list[int]) -> None:
        """One file of the words of some buckets with their numbers."""
        there = [(x, b) for x, b in zip(names, numbers) if x]
        n = sum(_arrays(x)["hash"][1][0] for x, _ in there)
        kind = np.uint32 if self.base.max() + n < 1 << 32 else np.int64
        hashes_, ids = (_read(x, "hash") for x, _ in there), (self.base[_read(x, "kind"), b] + _read(x, "rank") for x, b in there)
        _write(target, {"hash": (np.uint64, (n,), hashes_), "id": (kind, (n,), ids)})


_BLOBS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
_DDL = "bucket int, kind int, payload binary"


def _blobs(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _BLOBS.types)], schema=_BLOBS)


def _split(bucket: np.ndarray, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets and the rows that go there, in order."""
    by = np.argsort(bucket.astype(np.uint16), kind="stable")
    cut = np.searchsorted(bucket[by], np.arange(n_buckets + 1))
    for b in np.flatnonzero(np.diff(cut)).tolist():
        yield b, by[cut[b] : cut[b + 1]]


def _count_words(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words, _ in groups(batch, 0):
                word, _, _, count = distinct(words)
                yield _blobs([(b, 0, pickle.dumps((pack_sorted(word[at]), pack(count[at])), 5)) for b, at in _split(bucket_of(word, n_buckets), n_buckets)])

    return run


def _number_words(path: str):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        parts = [pickle.loads(x) for x in table.column("payload").to_pylist()]
        (word,), (count,) = sum_equal([np.concatenate([unpack_sorted(p[0]) for p in parts])], [np.concatenate([unpack(p[1]) for p in parts])])
        kind = np.minimum(np.floor(np.log2(count.astype(float))), 63).astype(np.uint8)
        by = np.argsort(kind, kind="stable")
        sizes = np.bincount(kind, minlength=64)
        rank = np.empty(len(word), np.uint32)
        rank[by] = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        _save(os.path.join(path, f"words-{bucket:05d}"), hash=word, kind=kind, rank=rank)
        return pa.Table.from_batches([_blobs([(bucket, 0, np.append(sizes, count.sum()).astype(np.int64).tobytes())])])

    return run


# n-grams


def _gram_rows(columns: list[np.ndarray], counts: np.ndarray, bucket: np.ndarray, n_buckets: int) -> list[tuple[int, int, bytes]]:
    """Sorted n-grams with counts, by bucket."""
    return [(b, 0, pickle.dumps((pack_sorted(columns[0][at]), [pack(c[at]) for c in columns[1:]], pack(counts[at])), 5)) for b, at in _split(bucket, n_buckets)]


def _count(order: int, vocabulary: Vocabulary, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words, docs in groups(batch, 0):
                columns, _ = sequences(vocabulary.ids(words), docs, order)
                columns, (counts,) = sum_equal(columns, [np.ones(len(columns[0]), np.int64)])
                bucket = gram_buckets(columns, vocabulary.hot_limit, n_buckets)[3]
                yield _blobs(_gram_rows(columns, counts, bucket, n_buckets))

    return run


def _by_context(context: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Contexts in order of their hashes, their totals and numbers of successors with counts of 1, 2 and 3 or more."""
    (h,), values = sum_equal([context], [counts, (counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts >= 3).astype(np.int64)])
    return h, values


def _reduce(path: str, k: int, limit: int, n_buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one bucket of n-grams of k words: writes them and their contexts, passes on the n-grams without their first word, what is
        known of hot contexts, and counts of counts.  What comes in of hot contexts of the order above is added up and written."""
        bucket = table.column("bucket")[0].as_py()
        rows, parts, above = [], [], []
        for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist()):
            if kind >= 10:
                rows.append((bucket, kind, payload))
            else:
                (above if kind else parts).append(pickle.loads(payload))
        if above:
            (h,), values = sum_equal([np.concatenate([unpack_sorted(p[0]) for p in above])], [np.concatenate([unpack(p[1][k]) for p in above]).astype(np.int64) for k in range(4)])
            save_table(os.path.join(path, f"hot{k + 1}-{bucket:05d}"), h, values)
        if not parts:
            return pa.Table.from_batches([_blobs(rows)])
        columns = [np.concatenate([unpack_sorted(p[0]) for p in parts]).astype(np.int64)]
        columns += [np.concatenate([unpack(p[1][c]) for p in parts]).astype(np.int64) for c in range(k - 1)]
        counts = np.concatenate([unpack(p[2]) for p in parts]).astype(np.int64)
        del parts
        columns, (counts,) = sum_equal(columns, [counts])
        context, gram, hot, _ = gram_buckets(columns, limit, n_buckets)
        save_table(os.path.join(path, f"gram{k}-{bucket:05d}"), gram, [counts])
        rows.append((bucket, 10 + k, _tell(counts).tobytes()))
        if k > 1:
            h, values = _by_context(context[~hot], counts[~hot])
            save_table(os.path.join(path, f"context{k}-{bucket:05d}"), h, values)
            h, values = _by_context(context[hot], counts[hot])
            rows += [(b, 1, pickle.dumps((pack_sorted(h[at]), [pack(v[at]) for v in values]), 5)) for b, at in _split(bucket_of(h, n_buckets), n_buckets)]
            lower, (n,) = sum_equal(columns[1:], [np.ones(len(counts), np.int64)])
            rows += _gram_rows(lower, n, gram_buckets(lower, limit, n_buckets)[3], n_buckets)
        return pa.Table.from_batches([_blobs(rows)])

    return run


def discounts(tell: np.ndarray) -> np.ndarray:
    """D1, D2 and D3 of modified Kneser-Ney smoothing from the counts of counts; 0 to 3 stand for counts 0 to 3 and more."""
    n1, n2, n3, n4 = (float(x) for x in tell[:4])
    if min(n1, n2, n3, n4) <= 0:
        return np.array([0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0, 0.01, 0.01, 0.01], [0, 1, 2, 3])


def _changes(counts: np.ndarray, own: np.ndarray) -> np.ndarray:
    """What taking off `own` takes from the total and from the numbers of n-grams with counts of 1, 2 and 3 or more."""
    before, after = np.minimum(counts, 3), np.minimum(counts - own, 3)
    return np.stack([own, *((before == i).astype(np.int64) - (after == i) for i in (1, 2, 3))])


@dataclass
class KneserNey:
    """The model in the vocabulary's path: counts of counts of the n-grams of each order, words first."""

    vocabulary: Vocabulary
    n_buckets: int
    order: int = ORDER
    told: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.told = self.told or [np.zeros(7, np.int64) for _ in range(self.order)]

    def _find(self, kind: str, h: np.ndarray, bucket: np.ndarray, width: int) -> np.ndarray:
        code, rare = np.full(len(h), _NONE, np.uint16), []
        for p, at in _split(part_of(bucket, self.n_buckets), part_count(self.n_buckets)):
            code[at], over, rows = _codes(os.path.join(self.vocabulary.path, f"{kind}.{p:05d}"), h.take(at), bucket.take(at))
            if len(over):
                rare.append((at.take(over), rows))
        return _decode(code, rare, width)

    def probabilities(self, columns: list[np.ndarray], doc: np.ndarray | None = None) -> np.ndarray:
        """Of the last word of each n-gram after the others.  doc: the document of each n-gram, whose own counts are taken off; all
        n-grams of a document must be there."""
        n, n_buckets, limit = len(columns[-1]), self.n_buckets, self.vocabulary.hot_limit
        mark = np.zeros(n, np.uint64) if doc is None else mix64(doc.astype(np.uint64) + _GOLDEN)
        # of each order: where one of each n-gram is, which each one is, and p = share + rest * (p of the order below)
        levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        lost: tuple[np.ndarray, np.ndarray] | None = None  # marked hashes of n-grams and what is taken off them
        for k in range(self.order, 0, -1):
            context, gram, hot, bucket = gram_buckets(columns[self.order - k :], limit, n_buckets)
            kind, first, of_kind, times = distinct(gram ^ mark)
            (count,) = self._find(f"gram{k}", gram.take(first), bucket.take(first), 1)
            own = np.zeros(len(kind), np.int64)
            if doc is not None:
                if k == self.order:
                    own = times
                elif lost is not None and len(lost[0]):
                    own[np.searchsorted(kind, lost[0])] = lost[1]
                own = np.minimum(own, count)  # of an n-gram that shares its slot
                gone = first[(own > 0) & (own == count)]
                if k > 1:
                    below, _, _, lower = distinct(hashes([c.take(gone) for c in columns[self.order - k + 1 :]])[1] ^ mark.take(gone))
                    lost = below, lower
            if k > 1:
                at, head, to, _ = distinct((context ^ mark).take(first))
                head = first.take(head)
                h, is_hot_ = context.take(head), hot.take(head)
                stats = self._find(f"context{k}", h, bucket_of(h, n_buckets), 4)
                if is_hot_.any():
                    stats[:, is_hot_] = self._find(f"hot{k}", h[is_hot_], bucket_of(h[is_hot_], n_buckets), 4)
            else:
                to = np.zeros(len(kind), np.int64) if doc is None else doc[first]
                stats = np.repeat(self.told[0][[6, 0, 1, 4]][:, None], int(to.max(initial=0)) + 1, axis=1)
            if doc is not None:
                for row, change in zip(stats, _changes(count, own)):
                    row -= np.bincount(to, change, len(row)).astype(np.int64)
                stats = np.maximum(stats, 0) if k > 1 else stats
            total, n1, n2, n3 = stats
            d, whole = discounts(self.told[k - 1]), np.maximum(total, 1)
            rest = np.where(total > 0, (d[1] * n1 + d[2] * n2 + d[3] * n3) / whole, 1.0)
            left = count - own
            levels.append((first, of_kind, np.where(total > 0, 1 / whole, 0).take(to) * (left - d.take(left, mode="clip")), rest.take(to)))
        p = np.full(n, 1.0 / (self.told[0][5] + 1))
        for first, of_kind, share, rest in levels[::-1]:
            p = (share + rest * p.take(first)).take(of_kind)
        return p


def fit(docs: DataFrame, text_col: str = "text", order: int = ORDER, hot: int = HOT) -> KneserNey:
    """Counts the model over all documents and writes it to the shared folder."""
    if order < 2:
        raise ValueError("the order must be 2 or more")
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(text_col).alias("text"))
    n_buckets = bucket_count(texts, 1.2)  # of words
    path = shared_path(spark, "kneser-ney")

    def join(tables: list[str], n: int, write: Callable[[str, list[str], list[int]], None]) -> None:
        parts = part_count(n)
        spark.sparkContext.parallelize(range(parts), parts).foreach(lambda p: [_join(path, x, n, p, write) for x in tables])

    counted = texts.mapInArrow(_count_words(n_buckets), _DDL).groupBy("bucket").applyInArrow(_number_words(path), _DDL)
    sizes, n_words = np.zeros((64, n_buckets), np.int64), 0
    for row in counted.select("bucket", "payload").collect():  # a short row for each bucket
        *sizes[:, row["bucket"]], here = np.frombuffer(row["payload"], np.int64)
        n_words += int(here)
    falling = sizes[::-1].ravel()
    base = (WORDS + np.cumsum(falling) - falling).reshape(64, n_buckets)[::-1]
    vocabulary = Vocabulary(path, n_buckets, base, WORDS + int(sizes[hot:].sum()))
    shared = spark.sparkContext.broadcast(vocabulary)  # 512 bytes for each bucket
    join(["words"], n_buckets, lambda *x: shared.value.join(*x))
    n_buckets = min(1 << 16, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_words // BUCKET_WORDS))
    model = KneserNey(vocabulary, n_buckets, order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _count(order, shared.value, n_buckets)(batches)

    rows = texts.mapInArrow(count, _DDL)
    for k in range(order, 0, -1):
        rows = rows.groupBy("bucket").applyInArrow(_reduce(path, k, vocabulary.hot_limit, n_buckets), _DDL)
    for row in rows.select("kind", "payload").collect():  # a short row for each bucket and order
        model.told[row["kind"] - 11] += np.frombuffer(row["payload"], np.int64)
    join([f"gram{k}" for k in range(1, order + 1)] + [f"{x}{k}" for x in ("context", "hot") for k in range(2, order + 1)], n_buckets, join_tables)
    return model


def score(docs: DataFrame, model: KneserNey, text_col: str = "text", id_col: str = "doc_id", leave_out: bool = True) -> DataFrame:
    """A row for each document: doc_id, n_tokens (with the end mark), log_prob and perplexity.

    leave_out: the documents are those that the model was fitted on, and their own counts are taken off."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for low, last, words, docs_ in groups(batch, 1, SCORE_TEXT):
                columns, doc = sequences(m.vocabulary.ids(words), docs_, m.order)
                n = np.bincount(doc, minlength=last - low)
                logs = np.log(m.probabilities(columns, doc if leave_out else None)) if len(doc) else None
                total = np.bincount(doc, logs, last - low).astype(float)
                perplexity = pa.array(np.exp(-total / np.maximum(n, 1)), mask=n == 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, last - low), pa.array(n, pa.int64()), pa.array(total), perplexity], ["doc_id", "n_tokens", "log_prob", "perplexity"]
                )

    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, n_tokens bigint, log_prob double, perplexity double")


def score_perplexity(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", order: int = ORDER) -> DataFrame:
    """Fits the model on the documents and scores each of them by all others."""
    return score(docs, fit(docs, text_col, order), text_col, id_col)


def brute_force(texts: list[list[str]], order: int = ORDER, leave_out: bool = True) -> list[float]:
    """Log probabilities of word lists under the same model, from plain dictionaries, for tests."""
    from collections import Counter

    def grams(words: list[str]) -> list[tuple[str, ...]]:
        padded = ["<s>"] * (order - 1) + words + ["</s>"]
        return [tuple(padded[k : k + order]) for k in range(len(words) + 1)] if words else []

    def count(lists: list[list[str]]) -> list[Counter]:
        counts: list[Counter] = [Counter() for _ in range(order)]
        for words in lists:
            counts[-1].update(grams(words))
        for k in range(order - 1, 0, -1):
            counts[k - 1].update(g[1:] for g in counts[k])
        return counts

    whole = count(texts)
    d = [discounts(_tell(np.array(list(c.values()), np.int64))) for c in whole]

    def log_prob(words: list[str], counts: list[Counter]) -> float:
        total: list[Counter] = [Counter() for _ in range(order)]
        kinds: list[dict[tuple[str, ...], Counter]] = [{} for _ in range(order)]
        for k in range(order):
            for g, c in counts[k].items():
                total[k][g[:-1]] += c
                kinds[k].setdefault(g[:-1], Counter())[min(c, 3)] += 1

        def probability(g: tuple[str, ...]) -> float:
            k = len(g) - 1
            below = probability(g[1:]) if k else 1 / (len(whole[0]) + 1)
            t = total[k][g[:-1]]
            if not t:
                return below
            c, seen = counts[k][g], kinds[k][g[:-1]]
            return max(c - d[k][min(c, 3)], 0) / t + sum(d[k][i] * seen[i] for i in (1, 2, 3)) / t * below

        return float(sum(np.log(probability(g)) for g in grams(words)))

    return [log_prob(words, count(texts[:k] + texts[k + 1 :]) if leave_out else whole) for k, words in enumerate(texts)]
