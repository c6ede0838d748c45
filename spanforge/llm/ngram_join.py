"""N-gram Jaccard join: for each document the group of near duplicates that it is in and how many links it has in it, where two
texts are linked if their sets of word n-grams have at least a given Jaccard similarity.

The result is exact for the 48-bit hashes of the n-grams (two sets of a few hundred n-grams are brought one n-gram closer by chance
about once in 3 * 10**9 pairs).  How it is found:

1. Each document becomes a set of n-gram hashes.  A block of documents sends the sorted hashes with the numbers of its documents,
   delta-coded and compressed, to the bucket of their range, where document frequencies are added up.  Of an n-gram that many
   documents of a block have (`COMMON`) only the count goes there, so no bucket holds more than a few entries a block of any n-gram.
   The blocks get the frequencies of the n-grams that more than one document has.
2. At its block, a document has its shared n-grams in the global order (frequency, hash), after those of its own.  By the prefix
   bound, two similar documents share one of the first |S| - ceil(t|S|) + 1 n-grams, so most documents have no candidate n-gram
   left.  Documents with the same set become one class, which has a number of its own, as an id may be in several.
3. Classes meet in the buckets of their prefix n-grams.  At the first n-gram that two similar sets have in common, what follows it
   in either set must make up the overlap t/(1+t) (|A|+|B|); a pair that meets this bound at no n-gram of the bucket isn't similar.
   A bucket passes on a spanning forest of the pairs that meet it, never the pairs.  N-grams of very many documents (`HOT`) are
   matched in blocks of classes.
4. In each connected component the sets are stored in a prefix tree, in one order of n-grams.  Each set walks down the tree, the
   overlap with a shared path is counted once, and subtrees are left when the lengths remaining in both can't make
   up the needed overlap.  Large components (`COMPONENT`) are cut into blocks by size of set and hash; blocks of fitting sizes meet.

Defined cases: documents with fewer than n words have their whole word sequence as the one n-gram; documents without
words (null and empty texts, punctuation) and rows of null id have no links; rows of the same id and different texts are
matched each and may be linked with each other, rows that repeat both are one; equal texts are similar with 1.0; an empty table
has no rows; other columns aren't read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from spanforge.llm.common import bucket_count, checkpoint, shielded, ship
from spanforge.llm.textkernel import blocks, mix64, ngram_hashes, pack, pack_sorted, unpack, unpack_sorted

N = 3
THRESHOLD = 0.5
#: Documents and bytes of text that share a block; the number of a document in its block has 16 bits.
BLOCK_DOCS, BLOCK_TEXT = 1 << 15, 24 << 20
#: Documents of a block from which an n-gram's occurrences stay with the block.
COMMON = 16
#: Documents from which an n-gram is matched in blocks of about so many classes.
HOT = 1 << 17
#: Classes and bytes of a component (or block of one) that one task joins.
COMPONENT = 1 << 12, 64 << 20
#: Losers of a deduplication that are broadcast rather than joined by a shuffle (8 bytes each).
BROADCAST_ROWS = 4_000_000
#: Edges of a graph whose components the driver finds (16 bytes each).
DRIVER_EDGES = 1 << 20

_LOW = np.uint64(0xFFFF)
_16 = np.uint64(16)


def prefix_length(size: np.ndarray, t: float) -> np.ndarray:
    return size - np.ceil(t * size - 1e-9).astype(np.int64) + 1


def _planes(values: np.ndarray) -> bytes:
    """The low six bytes of each 64-bit integer, byte by byte, as they compress best."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :6] = planes.T
    return out.view("<u8").ravel()


def _batch(schema: pa.Schema, columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def document_grams(texts: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each block of rows: first and last row, n-gram hashes with repeats, and the row of each."""
    for block in blocks(texts):
        starts, ends, docs = block.words()
        words = block.hash_ranges(starts, ends)
        grams, rows = ngram_hashes(words, docs, n)
        counts = np.bincount(docs, minlength=block.n_docs)
        for m in range(1, n):
            few = counts[docs] == m
            if few.any():
                g, r = ngram_hashes(words[few], docs[few], m)
                grams, rows = np.concatenate([grams, g ^ np.uint64(m)]), np.concatenate([rows, r])
        yield block.first, block.last, grams, rows + block.first


_OCCURRENCES = pa.schema([("bucket", pa.int32()), ("uid", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
_SHARED = pa.schema([("uid", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
_SETS = pa.schema(
    [("doc_id", pa.int64()), ("rep", pa.int64()), ("sig1", pa.int64()), ("sig2", pa.int64()), ("size", pa.int32()), ("first", pa.int32()), ("heavy", pa.binary()), ("tokens", pa.binary())]
)
_POSTINGS = pa.schema([("task", pa.int64()), ("payload", pa.binary())])
_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])
_LINKS = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("top", pa.int64())])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("jaccard", pa.float64())])
_SIGNS = ["sig1", "sig2", "size"]


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary", pa.float64(): "double"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _bounds(n_buckets: int) -> np.ndarray:
    """The least 48-bit hash of each bucket but the first."""
    return np.array([(b << 48) // n_buckets for b in range(1, n_buckets)], np.uint64)


def set_signatures(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the two signatures and the size of its set of n-grams, as `_scan` has them."""
    out = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int32)
    for _, _, grams, rows in document_grams(texts, n):
        gram = grams >> _16
        order = np.lexsort((gram, rows))
        gram, rows = gram[order], rows[order]
        new = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (rows[1:] != rows[:-1]))) if len(rows) else rows
        hashed, rows = mix64(gram[new]), rows[new]
        np.add.at(out[0], rows, hashed)
        np.add.at(out[1], rows, mix64(hashed + np.uint64(0x1234567)))
        np.add.at(out[2], rows, 1)
    return out[0].view(np.int64), out[1].view(np.int64), out[2]


def _scan(n: int, n_buckets: int, common: int):
    bounds = _bounds(n_buckets)

    def block_rows(uid: int, ids: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        keys.sort()
        if len(keys):
            keys = keys[np.append(True, keys[1:] != keys[:-1])]
        doc, gram = (keys & _LOW).astype(np.uint16), keys >> _16
        order = np.argsort(doc, kind="stable")
        sizes = np.bincount(doc, minlength=len(ids))
        used = np.flatnonzero(sizes)
        begin = (np.cumsum(sizes) - sizes)[used]
        hashed = mix64(gram[order])
        sigs = [np.zeros(len(ids), np.uint64) for _ in range(2)]
        if len(used):
            sigs[0][used] = np.add.reduceat(hashed, begin)
            sigs[1][used] = np.add.reduceat(mix64(hashed + np.uint64(0x1234567)), begin)
        run = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, int)
        counts = np.diff(np.append(run, len(gram)))
        often = counts > common
        stay = np.repeat(often, counts)
        known = pickle.dumps((ids, sizes.astype(np.int32), *sigs, pack_sorted(keys[stay])), 5)
        out: list[list] = [[uid % n_buckets], [uid], [1], [known]]
        sent, many, times = keys[~stay], gram[run[often]], counts[often]
        cut, cut_many = np.searchsorted(sent >> _16, bounds), np.searchsorted(many, bounds)
        for b, (part, few, count) in enumerate(zip(np.split(sent, cut), np.split(many, cut_many), np.split(times, cut_many))):
            if len(part) or len(few):
                payload = pickle.dumps((pack_sorted(part), pack_sorted(few), pack(count)), 5)
                for column, v in zip(out, (b, uid, 0, payload)):
                    column.append(v)
        return _batch(_OCCURRENCES, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 32
        ids: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        held, text = 0, 0
        for batch in batches:
            number = batch.column(0).to_numpy(zero_copy_only=False)
            for first, last, grams, rows in document_grams(batch.column(1), n):
                while first < last:  # rarely more than once: a block may be fuller than the one that is being filled
                    take = min(last, first + BLOCK_DOCS - held)
                    here = (rows >= first) & (rows < take) if take < last or first else slice(None)
                    local = (rows[here] - first + held).astype(np.uint64)
                    keys.append((grams[here] & ~_LOW) | local)
                    ids.append(number[first:take])
                    held, text, first = held + take - first, text + 8 * len(local), take
                    if held >= BLOCK_DOCS or text >= BLOCK_TEXT * 2:
                        yield block_rows(uid, np.concatenate(ids), np.concatenate(keys))
                        uid, ids, keys, held, text = uid + 1, [], [], 0, 0
        if held:
            yield block_rows(uid, np.concatenate(ids), np.concatenate(keys))

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Of one bucket: for each block the occurrences of n-grams that more than one document has, with frequencies."""
    uids, kinds, payloads = (table.column(c).to_pylist() for c in ("uid", "kind", "payload"))
    out: list[list] = [[], [], []]
    parts: list[tuple[int, np.ndarray, np.ndarray]] = []
    every, extra, times = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for k, (uid, kind) in enumerate(zip(uids, kinds)):
        if kind:
            for column, v in zip(out, (uid, 1, payloads[k])):
                column.append(v)
        else:
            keys, many, count = pickle.loads(payloads[k])
            keys, many = unpack_sorted(keys), unpack_sorted(many)
            parts.append((uid, keys, many))
            every.append(keys >> _16)
            extra.append(many)
            times.append(unpack(count))
        payloads[k] = None
    if parts:
        gram = np.concatenate(every)
        del every
        gram.sort()
        begin = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, int)
        gram, df = gram[begin], np.diff(np.append(begin, len(gram))).astype(np.int64)
        many, of_many = np.unique(np.concatenate(extra), return_inverse=True)
        count = np.bincount(of_many.ravel(), np.concatenate(times), len(many)).astype(np.int64)
        if len(many):
            at = np.minimum(np.searchsorted(gram, many), max(len(gram) - 1, 0))
            both = gram[at] == many if len(gram) else np.zeros(len(many), bool)
            count[both] += df[at[both]]
            df[at[both]] = count[both]
        shared = gram[df > 1]
        df = df[df > 1]
        for uid, keys, own in parts:
            at = np.searchsorted(shared, keys >> _16)
            hit = at < len(shared)
            hit[hit] = shared[at[hit]] == keys[hit] >> _16
            if hit.any() or len(own):
                payload = pickle.dumps((pack_sorted(keys[hit]), pack(df[at[hit]]), pack_sorted(own), pack(count[np.searchsorted(many, own)])), 5)
                for column, v in zip(out, (uid, 0, payload)):
                    column.append(v)
    return pa.Table.from_batches([_batch(_SHARED, out)])


def _sets(t: float, hot: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one block: the documents with candidate n-grams, their shared n-grams in the global order (of equal sets once).

        rep: a number for the set; first: how many of the n-grams are in the prefix; heavy: the frequencies of those in the prefix that
        are above `hot`."""
        keys, dfs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        grams, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        ids = sizes = sig1 = sig2 = np.zeros(0, np.int64)
        stayed = np.zeros(0, np.uint64)
        for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist()):
            if kind:
                ids, sizes, sig1, sig2, stayed = pickle.loads(payload)
                stayed = unpack_sorted(stayed)
            else:
                part, df, own, count = pickle.loads(payload)
                keys.append(unpack_sorted(part))
                dfs.append(unpack(df))
                grams.append(unpack_sorted(own))
                counts.append(unpack(count))
        gram, count = np.concatenate(grams), np.concatenate(counts)
        order = np.argsort(gram)
        if len(stayed):
            keys.append(stayed)
            dfs.append(count[order][np.searchsorted(gram[order], stayed >> _16)])
        key, df = np.concatenate(keys), np.concatenate(dfs)
        doc = (key & _LOW).astype(np.int64)
        shared = np.bincount(doc, minlength=len(ids))
        first = prefix_length(sizes.astype(np.int64), t) - (sizes - shared)
        wanted = (first > 0) & (shared > 0)
        rows = np.flatnonzero(wanted)
        sets = np.stack([sig1[rows].view(np.int64), sig2[rows].view(np.int64), sizes[rows].astype(np.int64)], axis=1)
        holds, rep = np.zeros(len(ids), bool), np.zeros(len(rows), np.int64)  # the first of equal sets has the n-grams
        if len(rows):
            _, holder, of_set = np.unique(sets, axis=0, return_index=True, return_inverse=True)
            holds[rows[holder]] = True
            rep = (table.column("uid")[0].as_py() << 16) + rows[holder][of_set.ravel()]
        keep = holds[doc]
        doc, key, df = doc[keep], key[keep] >> _16, df[keep]
        order = np.lexsort((key, df, doc))
        key, df = key[order], df[order]
        at = np.append(0, np.cumsum(shared[holds]))
        tokens: list[bytes | None] = [None] * len(rows)
        heavy: list[bytes | None] = [None] * len(rows)
        for k, row in enumerate(np.flatnonzero(holds)):
            place = int(np.searchsorted(rows, row))
            a, z = at[k], at[k + 1]
            tokens[place] = _planes(key[a:z])
            last = df[a : a + min(first[row], z - a)]
            if len(last) and last[-1] > hot:
                heavy[place] = pack(last[last > hot])
        columns = [ids[rows], rep, sets[:, 0], sets[:, 1], sets[:, 2], first[rows], heavy, tokens]
        return pa.Table.from_batches([_batch(_SETS, columns)])

    return run


def _postings(n_buckets: int, t: float, hot: int):
    bounds = _bounds(n_buckets)

    def payload(token: np.ndarray, reps: np.ndarray, sizes: np.ndarray, rest: np.ndarray, side: int) -> bytes:
        used, local = np.unique(reps, return_inverse=True)
        size = np.zeros(len(used), np.int64)
        size[local.ravel()] = sizes
        return pickle.dumps((pack_sorted(token), pack(local.ravel()), pack(rest), pack_sorted(used), pack(size), side), 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The prefix n-grams of classes, with the number of n-grams from there to the end of the set."""
        for batch in batches:
            reps, sizes, firsts = (batch.column(k).to_numpy().astype(np.int64) for k in range(3))
            lists = [_unplanes(x) for x in batch.column(4).to_pylist()]
            if not lists:
                continue
            shared = np.array([len(x) for x in lists])
            firsts = np.minimum(firsts, shared)
            token = np.concatenate([x[:f] for x, f in zip(lists, firsts)])
            row = np.repeat(np.arange(len(lists)), firsts)
            rest = shared[row] - (np.arange(len(row)) - np.repeat(np.cumsum(firsts) - firsts, firsts))
            df = np.zeros(len(token), np.int64)
            ends = np.cumsum(firsts)
            for k, x in enumerate(batch.column(3).to_pylist()):
                if x is not None:
                    above = unpack(x)
                    df[ends[k] - len(above) : ends[k]] = above
            out: list[list] = [[], []]
            order = np.argsort(token, kind="stable")
            token, row, rest, df = token[order], row[order], rest[order], df[order]
            usual = df == 0
            for b, at in enumerate(np.split(np.flatnonzero(usual), np.searchsorted(token[usual], bounds))):
                if len(at):
                    out[0].append(b)
                    out[1].append(payload(token[at], reps[row[at]], sizes[row[at]], rest[at], 0))
            begin = np.flatnonzero(~usual)
            for at in np.split(begin, np.flatnonzero(np.diff(token[begin])) + 1) if len(begin) else ():
                n_blocks = -(-int(df[at[0]]) // hot)
                block = (mix64(reps[row[at]].astype(np.uint64)) % np.uint64(n_blocks)).astype(np.int64)
                for i in np.unique(block):
                    here = at[block == i]
                    for j in range(n_blocks):
                        low, high = sorted((int(i), j))
                        number = mix64(np.array([token[here[0]] ^ np.uint64((low * n_blocks + high + 1) << 20)], np.uint64))[0]
                        out[0].append(int(number >> np.uint64(1)) | 1 << 40)
                        out[1].append(payload(token[here], reps[row[here]], sizes[row[here]], rest[here], 0 if low == high else 1 + (int(i) == high)))
            yield _batch(_POSTINGS, out)

    return run


def _candidates(t: float, most: int = 1 << 22):
    def run(table: pa.Table) -> pa.Table:
        """Of one bucket of n-grams: a spanning forest of the pairs of classes that meet the bound at one of them."""
        parts = [pickle.loads(x) for x in table.column("payload").to_pylist()]
        used = [unpack_sorted(p[3]).astype(np.int64) for p in parts]
        reps, local = np.unique(np.concatenate(used), return_inverse=True)
        local = local.ravel()
        sizes = np.zeros(len(reps), np.int64)
        sizes[local] = np.concatenate([unpack(p[4]) for p in parts])
        at = np.cumsum([0] + [len(x) for x in used])
        token = np.concatenate([unpack_sorted(p[0]) for p in parts])
        row = np.concatenate([local[a + unpack(p[1]).astype(np.int64)] for a, p in zip(at, parts)])
        rest = np.concatenate([unpack(p[2]) for p in parts]).astype(np.int64)
        side = np.repeat([p[5] for p in parts], [len(unpack(p[1])) for p in parts])
        size = sizes[row]
        order = np.lexsort((size, token))
        token, row, rest, side, size = token[order], row[order], rest[order], side[order], size[order]
        run_no = np.cumsum(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, int)
        # the largest partner for which the rest of the set suffices
        limit = np.floor(rest * (1 + t) / t - size + 1e-6).astype(np.int64)
        largest = np.minimum(limit, np.floor(size / t + 1e-9).astype(np.int64))
        key = run_no.astype(np.int64) << 32 | size
        high = np.searchsorted(key, run_no.astype(np.int64) << 32 | np.clip(largest, 0, (1 << 32) - 1), side="right")
        begin = np.arange(len(token)) + 1
        counts = np.where(largest >= size, np.maximum(high - begin, 0), 0)
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        upto = np.append(0, np.cumsum(counts))
        start = 0
        while start < len(counts):
            stop = max(start + 1, int(np.searchsorted(upto, upto[start] + most, side="right")) - 1)
            for low in range(0, int(upto[stop] - upto[start]) or 1, most):  # a row alone may have more
                n = counts[start:stop] if stop - start > 1 else np.array([min(most, counts[start] - low)])
                x = np.repeat(np.arange(start, stop), n)
                y = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + begin[x] + (low if stop - start == 1 else 0)
                fits = (limit[y] >= size[x]) & (row[x] != row[y]) & ((side[x] == 0) | (side[x] != side[y]))
                p = np.unique(np.minimum(row[x], row[y])[fits] * len(reps) + np.maximum(row[x], row[y])[fits])
                if len(p):
                    root = find_roots(len(reps), np.concatenate([a, p // len(reps)]), np.concatenate([b, p % len(reps)]))
                    b = np.flatnonzero(root != np.arange(len(reps)))
                    a = root[b]
                if stop - start > 1:
                    break
            start = stop
        return pa.Table.from_batches([_batch(_EDGES, [reps[a], reps[b]])])

    return run


def find_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of the connected component of each of n vertices."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Marked for a broadcast if it has few rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def components(edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> tuple[DataFrame, int]:
    """(node, component) of an undirected graph of bigint vertices u, v, and the number of nodes; a component is named by its least vertex.

    A graph of at most `driver_edges` edges is solved by the driver.  Larger ones alternate large-star and small-star steps, which
    takes a few rounds whatever the diameter."""
    edges = checkpoint(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    if edges.count() <= driver_edges:
        found = edges.toArrow()
        u, v = found.column("u").to_numpy(), found.column("v").to_numpy()
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = find_roots(len(nodes), *np.split(at.ravel(), 2))
        solved = pa.table({"node": pa.array(nodes, pa.int64()), "component": pa.array(nodes[root], pa.int64())})
        return edges.sparkSession.createDataFrame(solved), len(nodes)
    w = Window.partitionBy("u")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", F.min("v").over(w))).filter("v > u").select(F.col("v"), F.col("m").alias("u")).filter("u <> v").distinct()
        small = large.select(F.col("v").alias("u"), F.col("u").alias("v")).withColumn("m", F.min("v").over(w))
        edges = checkpoint(
            small.select(F.explode(F.array("u", "v")).alias("v"), F.col("m").alias("u")).filter("u <> v").distinct()
        )
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            nodes = edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
            return nodes, nodes.count()
        last = state


class PrefixTree:
    """Sets of integers, each in ascending order, in a tree whose edges carry the runs between branchings."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        """sizes: of the whole sets; elements that only one set has may be missing in `sets`."""
        order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u4").tobytes())
        self.order = order
        self.sets, self.sizes = [sets[k] for k in order], sizes[np.array(order, int)]
        # nodes: run of elements, children, sets that end here, and over the subtree: last index, sizes, longest rest
        self.run: list[np.ndarray] = [np.zeros(0, np.uint32)]
        self.children: list[list[int]] = [[]]
        self.ending: list[list[int]] = [[]]
        path = [(0, 0)]  # (node, depth at its end)
        previous = np.zeros(0, np.uint32)
        for k, s in enumerate(self.sets):
            n = min(len(previous), len(s))
            differs = np.flatnonzero(previous[:n] != s[:n])
            common = int(differs[0]) if len(differs) else n
            child = None
            while path[-1][1] > common:
                child = path.pop()
            if path[-1][1] < common:  # the run of the child is split where the new set leaves it
                parent, depth = path[-1]
                middle = self._add(self.run[child[0]][: common - depth])
                self.run[child[0]] = self.run[child[0]][common - depth :]
                self.children[parent][-1] = middle
                self.children[middle].append(child[0])
                path.append((middle, common))
            if len(s) > common:
                node = self._add(s[common:])
                self.children[path[-1][0]].append(node)
                path.append((node, len(s)))
            self.ending[path[-1][0]].append(k)
            previous = s
        n = len(self.run)
        self.last, self.least, self.most, self.rest = [-1] * n, [1 << 60] * n, [0] * n, [0] * n
        stack = [(0, False)]
        while stack:
            node, done = stack.pop()
            if not done:
                stack.append((node, True))
                stack.extend((c, False) for c in self.children[node])
                continue
            for k in self.ending[node]:
                z = int(self.sizes[k])
                self.last[node], self.least[node], self.most[node] = max(self.last[node], k), min(self.least[node], z), max(self.most[node], z)
            for c in self.children[node]:
                self.last[node] = max(self.last[node], self.last[c])
                self.least[node], self.most[node] = min(self.least[node], self.least[c]), max(self.most[node], self.most[c])
                self.rest[node] = max(self.rest[node], self.rest[c] + len(self.run[c]))

    def _add(self, run: np.ndarray) -> int:
        self.run.append(run)
        self.children.append([])
        self.ending.append([])
        return len(self.run) - 1

    def pairs(self, t: float) -> Iterator[tuple[int, int, float]]:
        """Pairs of the given sets (their numbers) with a Jaccard similarity of at least t."""
        width = 1 + max((int(s[-1]) for s in self.sets if len(s)), default=0)
        has = np.zeros(width, np.uint8)
        for k, s in enumerate(self.sets):
            size = int(self.sizes[k])
            has[s] = 1
            least, most, share = t * size - 1e-9, size / t + 1e-9, t / (1 + t)
            stack = [(c, 0) for c in self.children[0]]
            for j in self.ending[0]:
                if j > k and not size and not self.sizes[j]:
                    yield self.order[k], self.order[j], 1.0
            while stack:
                node, overlap = stack.pop()
                if self.last[node] <= k or self.least[node] > most or self.most[node] < least:
                    continue
                run = self.run[node]
                overlap += int(np.add.reduce(has[run], dtype=np.int64))
                remaining = len(s) - int(s.searchsorted(run[-1], side="right"))
                need = share * (size + max(self.least[node], least)) - 1e-6
                for j in self.ending[node]:
                    if j > k:
                        jaccard = overlap / (size + int(self.sizes[j]) - overlap)
                        if jaccard >= t - 1e-12:
                            yield self.order[k], self.order[j], jaccard
                if overlap + min(remaining, self.rest[node]) >= need:
                    stack.extend((c, overlap) for c in self.children[node])
            has[s] = 0


def join_sets(tokens: list[np.ndarray], sizes: np.ndarray, t: float) -> list[tuple[int, int, float]]:
    """The similar pairs among some sets, by a prefix tree over the order of falling frequency among them."""
    flat = np.concatenate(tokens)
    _, code, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.uint32)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts), dtype=np.uint32)
    code = code.ravel()
    ranked = rank[code]
    ends = np.cumsum([len(x) for x in tokens])
    begins = ends - [len(x) for x in tokens]
    useful = counts[code] > 1
    sets = [np.sort(ranked[a:b][useful[a:b]]) for a, b in zip(begins, ends)]
    return list(PrefixTree(sets, sizes).pairs(t))


def _similar(table: pa.Table, t: float) -> list[tuple[int, int, float]]:
    """Pairs of rows of one component (or of two blocks of one, which have different sides)."""
    sizes, side = table.column("size").to_numpy().astype(np.int64), table.column("side").to_numpy()
    found = join_sets([_unplanes(x) for x in table.column("tokens").to_pylist()], sizes, t)
    return [p for p in found if side[p[0]] != side[p[1]]] if side.any() else found


def _link(t: float):
    def run(table: pa.Table) -> pa.Table:
        """For each class with links how many texts they lead to, and the first class of its group."""
        reps, n_ids = table.column("rep").to_numpy(), table.column("n_ids").to_numpy()
        found = _similar(table, t)
        a, b = (np.array([p[k] for p in found], np.int64) for k in (0, 1))
        links = (np.bincount(a, n_ids[b], len(reps)) + np.bincount(b, n_ids[a], len(reps))).astype(np.int64)
        by = np.argsort(reps)
        place = np.empty(len(reps), np.int64)
        place[by] = np.arange(len(reps))
        root = by[find_roots(len(reps), place[a], place[b])[place]]
        linked = np.flatnonzero(links)
        return pa.Table.from_batches([_batch(_LINKS, [reps[linked], links[linked], reps[root[linked]]])])

    return run


def _list(t: float):
    def run(table: pa.Table) -> pa.Table:
        reps = table.column("rep").to_numpy()
        found = _similar(table, t)
        low, high = ([f(reps[p[0]], reps[p[1]]) for p in found] for f in (min, max))
        return pa.Table.from_batches([_batch(_PAIRS, [low, high, [p[2] for p in found]])])

    return run


def _block_rows(placed: DataFrame, t: float, component: tuple[int, int]) -> DataFrame:
    """Rows of large components, once for each task (a pair of blocks) that they are in."""
    band = F.floor(F.log(F.col("size").cast("double")) / float(-np.log(t)) + 1e-9) if t < 1 else F.col("size")
    banded = placed.withColumn("band", band.cast("bigint"))
    count, volume = component
    blocks_ = F.greatest(F.ceil(F.count(F.lit(1)) / count), F.ceil(F.sum(F.length("tokens")) / volume)).cast("int")
    per = checkpoint(banded.groupBy("component", "band").agg(blocks_.alias("blocks")))

    def near(by: int, name: str) -> DataFrame:
        return per.select("component", (F.col("band") - by).alias("band"), F.col("blocks").alias(name))

    known = banded.join(per, ["component", "band"]).join(near(1, "above"), ["component", "band"], "left").join(near(-1, "below"), ["component", "band"], "left")
    own = F.pmod(F.xxhash64("rep"), "blocks").cast("int")

    def tasks(n: str, low, high, first: int, side) -> Column:
        """An entry for each block of the other band: the band of the lower one, both blocks, and the side of this row."""
        numbers = F.when(F.coalesce(F.col(n), F.lit(0)) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(
            numbers,
            lambda j: F.struct((F.col("band") + first).alias("low_band"), F.lit(n == "blocks").alias("same"), low(j).alias("i"), high(j).alias("j"), side(j).cast("int").alias("side")),
        )

    each = F.concat(
        tasks("blocks", lambda j: F.least(own, j), lambda j: F.greatest(own, j), 0, lambda j: F.when(own == j, 0).when(own < j, 1).otherwise(2)),
        tasks("above", lambda j: own, lambda j: j, 0, lambda j: F.lit(1)),
        tasks("below", lambda j: j, lambda j: own, -1, lambda j: F.lit(2)),
    )
    out = known.select("component", "rep", "size", "tokens", "n_ids", F.explode(each).alias("x"))
    return out.select("component", "x.low_band", "x.same", "x.i", "x.j", "x.side", "rep", "size", "tokens", "n_ids")


class Classes:
    """The classes of a table's documents: members (doc_id, sig1, sig2, size), classes (rep, sig1, sig2, size, least, n_ids), holders
    (rep, size, first, heavy, tokens), and which component of candidates each is in."""

    def __init__(self, docs: DataFrame, n: int, t: float, text_col: str, id_col: str, common: int = COMMON, hot: int = HOT, component: tuple[int, int] = COMPONENT):
        if not 0 < t <= 1:
            raise ValueError("the threshold must be in (0, 1]")
        ship(docs.sparkSession)
        self.t, self.component = t, component
        narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
        n_buckets = bucket_count(narrow, 1.5)
        occurrences = narrow.mapInArrow(_scan(n, n_buckets, common), _ddl(_OCCURRENCES))
        shared = occurrences.groupBy("bucket").applyInArrow(_shared, _ddl(_SHARED))
        sets = checkpoint(shared.groupBy("uid").applyInArrow(_sets(t, hot), _ddl(_SETS)))
        self.members = sets.groupBy("doc_id", *_SIGNS).agg(F.min("rep").alias("rep"))
        self.classes = checkpoint(self.members.groupBy(*_SIGNS).agg(F.min("rep").alias("rep"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_ids")))
        self.holders = sets.filter("tokens is not null").select("rep", "size", "first", "heavy", "tokens")
        # sets that several blocks hold count once
        held = sets.filter("tokens is not null").select(*_SIGNS, F.col("rep").alias("other"))
        again = checkpoint(held.join(self.classes, _SIGNS).filter("other <> rep").select(F.col("other").alias("rep")))
        self.holders = self.holders.join(_small(again, again.count()), "rep", "left_anti")
        postings = self.holders.mapInArrow(_postings(n_buckets, t, hot), _ddl(_POSTINGS))
        self.component_of, self.n_nodes = components(postings.groupBy("task").applyInArrow(_candidates(t), _ddl(_EDGES)))

    def tasks(self) -> tuple[DataFrame, DataFrame | None]:
        """The rows of small components, and those of large ones by pairs of blocks if there are any."""
        node = _small(self.component_of.withColumnRenamed("node", "rep"), self.n_nodes)
        known = _small(self.classes.join(node, "rep").select("rep", "n_ids", "component"), self.n_nodes)
        placed = self.holders.join(known, "rep").select("component", "rep", "size", "tokens", "n_ids")
        count, volume = self.component
        sizes = self.holders.select("rep", F.length("tokens").alias("b")).join(node, "rep").groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b"))
        large = checkpoint(sizes.filter((F.col("n") > count) | (F.col("b") > volume)).select("component"))
        if large.isEmpty():
            return placed.withColumn("side", F.lit(0)), None
        small = placed.join(large, "component", "left_anti").withColumn("side", F.lit(0))
        return small, _block_rows(placed.join(large, "component", "left_semi"), self.t, self.component)

    def pairs(self) -> DataFrame:
        """(a, b, jaccard) of all pairs of classes that are similar."""
        small, large = self.tasks()
        out = small.groupBy("component").applyInArrow(_list(self.t), _ddl(_PAIRS))
        if large is not None:
            out = out.unionByName(large.groupBy("component", "low_band", "same", "i", "j").applyInArrow(_list(self.t), _ddl(_PAIRS)))
        return out

    def linked(self) -> DataFrame:
        """(doc_id, sig1, sig2, size, class_id, n_links) of the documents that have links; class_id is the least id of the group."""
        small, large = self.tasks()
        links = small.groupBy("component").applyInArrow(_link(self.t), _ddl(_LINKS))
        if large is not None:
            parts = checkpoint(large.groupBy("component", "low_band", "same", "i", "j").applyInArrow(_link(self.t), _ddl(_LINKS)))
            top, _ = components(parts.select(F.col("rep").alias("u"), F.col("top").alias("v")))
            summed = parts.groupBy("rep").agg(F.sum("links").alias("links"))
            links = links.unionByName(summed.join(top, F.col("rep") == F.col("node")).select("rep", "links", F.col("component").alias("top")))
        known = self.classes.select("rep", *_SIGNS, "least", "n_ids").join(links, "rep", "left").filter("links is not null or n_ids > 1")
        known = checkpoint(
            known.select(*_SIGNS, "least", F.coalesce("top", "rep").alias("top"), (F.coalesce("links", F.lit(0)) + F.col("n_ids") - 1).alias("n_links"))
        )
        group = known.groupBy("top").agg(F.min("least").alias("class_id"))
        return self.members.drop("rep").join(known.join(group, "top").drop("top", "least"), _SIGNS)


def ngram_jaccard_join(
    docs: DataFrame, n: int = N, threshold: float = THRESHOLD, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """Rows (doc_id, class_id, n_links), one for each document (each different text of it) that has links: the least id of the group
    that links make, and the number of other texts that are similar to it.  `similar_pairs` gives the links themselves."""
    return Classes(docs, n, threshold, text_col, id_col).linked().select("doc_id", "class_id", "n_links")


def similar_pairs(
    docs: DataFrame, n: int = N, threshold: float = THRESHOLD, text_col: str = "text", id_col: str = "doc_id", **limits
) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, jaccard) of classes of equal sets, and membership (doc_id, rep).  limits: those of `Classes`."""
    c = Classes(docs, n, threshold, text_col, id_col, **limits)
    return c.pairs(), c.members.drop("rep").join(c.classes.select("rep", *_SIGNS), _SIGNS).select("doc_id", "rep")


def drop_near_duplicates(
    docs: DataFrame, n: int = N, threshold: float = THRESHOLD, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """The documents without near duplicates: of each group linked by similar pairs, the one of the least id stays.

    Of an id with several texts only those go that are near duplicates themselves.  Rows that agree in id and text are copies too,
    and one of them stays; rows of null id and documents without words all stay.  All columns are kept."""
    docs, restored = shielded(docs)
    linked = Classes(docs, n, threshold, text_col, id_col).linked()
    losers = checkpoint(
        linked.filter("doc_id <> class_id").select(F.col("doc_id").alias("__loser"), F.col("sig1").alias("__l1"), F.col("sig2").alias("__l2"), F.col("size").alias("__lsize"))
    )
    if losers.count() <= BROADCAST_ROWS:
        losers = F.broadcast(losers)
    lost = F.col(id_col) == F.col("__loser")
    repeated = checkpoint(
        docs.groupBy(F.col(id_col).alias("__id")).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1 and __id is not null").select("__id")
    )
    if repeated.isEmpty():
        return restored(docs.join(losers, lost, "left_anti"))
    few = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
    once = docs.join(few, F.col(id_col) == F.col("__id"), "left_anti").join(losers, lost, "left_anti")
    again = docs.join(few, F.col(id_col) == F.col("__id"), "left_semi")
    at = docs.columns.index(text_col)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [pa.array(x) for x in set_signatures(batch.column(at), n)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *marks], [*batch.schema.names, "__s1", "__s2", "__ssize"])

    signs = StructType([*again.schema.fields, StructField("__s1", LongType()), StructField("__s2", LongType()), StructField("__ssize", IntegerType())])
    same = (F.col("__s1") == F.col("__l1")) & (F.col("__s2") == F.col("__l2")) & (F.col("__ssize") == F.col("__lsize"))
    again = again.mapInArrow(sign, signs).join(losers, lost & same, "left_anti").drop("__s1", "__s2", "__ssize")
    first = Window.partitionBy(id_col, F.coalesce(F.col(text_col), F.lit(""))).orderBy(F.col(text_col).asc_nulls_first())
    return restored(once.unionByName(again.withColumn("__k", F.row_number().over(first)).filter("__k = 1").drop("__k")))


def brute_force(rows: list[tuple[int | None, str | None]], n: int = N, threshold: float = THRESHOLD) -> tuple[list[tuple[int, frozenset]], dict[tuple[int, int], float]]:
    """All different texts (id, n-gram set), and the similar pairs of their numbers, from all sets against each other, for tests."""
    sets: dict[tuple[int, frozenset], None] = {}
    for doc_id, text in rows:
        grams: set[int] = set()
        for _, _, g, _ in document_grams(pa.array([text], pa.string()), n):
            grams = set((g >> _16).tolist())
        if doc_id is not None and grams:
            sets[doc_id, frozenset(grams)] = None
    texts = list(sets)
    out: dict[tuple[int, int], float] = {}
    for i, (_, a) in enumerate(texts):
        for j in range(i + 1, len(texts)):
            b = texts[j][1]
            jaccard = len(a & b) / len(a | b)
            if jaccard >= threshold - 1e-12:
                out[i, j] = jaccard
    return texts, out


#: Words as `textkernel` has them.
WORD_SQL = r"[0-9a-z_\x{aa}\x{b5}\x{ba}\x{c0}-\x{1fff}\x{2080}-\x{2fff}\x{a000}-\x{10ffff}]+|[\x{3040}-\x{9fff}]"


def oracle(docs: str = "documents", n: int = N, threshold: float = THRESHOLD) -> str:
    """The same result in DuckDB's SQL, from all pairs that share an n-gram and the closure of the links."""
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_SQL}') AS w FROM {docs} WHERE doc_id IS NOT NULL),
grams AS MATERIALIZED (SELECT DISTINCT doc_id, hash(g) AS g FROM (
    SELECT doc_id, {gram} AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM words WHERE len(w) >= {n})
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND {n - 1})),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS z FROM grams GROUP BY doc_id),
pairs AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams AS x JOIN grams AS y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
    JOIN sizes AS s ON s.doc_id = a JOIN sizes AS r ON r.doc_id = b WHERE c >= {threshold} * (s.z + r.z - c) - 1e-9),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM pairs UNION SELECT reach.doc_id, pairs.b FROM reach JOIN pairs ON pairs.a = reach.other)
SELECT doc_id, min(other) AS class_id, any_value(n) AS n_links FROM reach JOIN (SELECT a, count(*) AS n FROM pairs GROUP BY a) ON a = doc_id GROUP BY doc_id
"""
