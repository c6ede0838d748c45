"""Packing of documents into sequences of fixed length by cutting-stock column generation.

A document of more tokens than a sequence holds is cut into full pieces and one rest.  Lengths are rounded up to
classes of `capacity / CLASSES` tokens, and the histogram of the classes is the demand of a cutting-stock problem: a linear
program over patterns (how many pieces of each class share a sequence), whose columns are priced by a knapsack dynamic
program over its dual prices.  Patterns are used as often as the solution says, rounded down; the few pieces left are placed
first-fit by falling length.  Then the pieces of each class are ranked, and rank intervals map to sequences.

The driver sees only the histogram, so its work doesn't depend on the size of the input.  The linear program bounds the
number of sequences from below (for rounded lengths); the result exceeds it by at most about one for each class.

Defined cases: null and empty texts have one piece of length 0 without a sequence (bin null); null ids are allowed (they
rank first); rows that repeat are packed each; an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import checkpoint, prefix_sum, ship

CAPACITY = 2048
CLASSES = 256
#: A token is a run of letters, digits, marks and underscores, or any other character that is no white space.
TOKEN = r"[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


def best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items that fits: its value and how often it has each item."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    sizes_, prices_ = sizes[order], prices[order]
    upto = np.searchsorted(sizes_, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if upto[c]:
            values = prices_[: upto[c]] + best[c - sizes_[: upto[c]]]
            k = int(values.argmax())
            if values[k] > best[c] + 1e-12:
                best[c], choice[c] = values[k], k
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[order[choice[c]]] += 1
            c -= sizes_[choice[c]]
    return float(best[capacity]), pattern


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used in an optimal solution of the linear program, by column generation."""
    m = len(sizes)
    patterns = np.diag(capacity // sizes).astype(np.int64)
    inverse = np.diag(1.0 / np.diag(patterns)) if m else np.zeros((0, 0))
    x = inverse @ demand
    for _ in range(rounds if m else 0):
        prices = inverse.sum(axis=0)
        value, pattern = best_pattern(prices, sizes, capacity)
        if value <= 1 + 1e-9:
            break
        direction = inverse @ pattern
        up = direction > 1e-11
        ratio = np.full(m, np.inf)
        ratio[up] = np.maximum(x[up], 0) / direction[up]
        out = int(ratio.argmin())
        x = x - ratio[out] * direction
        x[out] = ratio[out]
        row = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, row)
        inverse[out] = row
        patterns[out] = pattern
    return patterns, np.maximum(x, 0)


def plan_bins(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[np.ndarray, int]], float]:
    """Patterns over sizes 1..capacity with whole numbers of uses that cover the histogram, and the linear bound."""
    sizes = np.array(sorted(k for k, n in histogram.items() if n > 0), np.int64)
    demand = np.array([histogram[int(k)] for k in sizes], np.int64)
    patterns, x = solve_patterns(sizes, demand.astype(float), capacity)
    used: dict[bytes, int] = {}
    left = demand.copy()
    for k in np.argsort(-x, kind="stable"):
        p = patterns[k]
        has = p > 0
        times = min(int(x[k] + 1e-7), int((left[has] // p[has]).min())) if has.any() else 0
        if times > 0:
            left -= times * p
            used[p.tobytes()] = used.get(p.tobytes(), 0) + times
    # what rounding leaves over: first fit by falling length
    room: list[int] = []
    content: list[np.ndarray] = []
    for i in range(len(sizes) - 1, -1, -1):
        for _ in range(int(left[i])):
            b = next((b for b, r in enumerate(room) if r >= sizes[i]), None)
            if b is None:
                room.append(capacity)
                content.append(np.zeros(len(sizes), np.int64))
                b = len(room) - 1
            room[b] -= int(sizes[i])
            content[b][i] += 1
    for p in content:
        used[p.tobytes()] = used.get(p.tobytes(), 0) + 1
    full = []
    for p, times in used.items():
        counts = np.zeros(capacity + 1, np.int64)
        counts[sizes] = np.frombuffer(p, np.int64)
        full.append((counts, times))
    return full, float(x.sum())


def rank_intervals(bins: list[tuple[np.ndarray, int]], n_classes: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each class: where rank intervals begin, the first bin of each and how many pieces of it a bin has."""
    begin: dict[int, list[int]] = {}
    first: dict[int, list[int]] = {}
    per: dict[int, list[int]] = {}
    taken = [0] * (n_classes + 1)
    base = 0
    for counts, times in bins:
        for k in np.flatnonzero(counts):
            k = int(k)
            begin.setdefault(k, []).append(taken[k])
            first.setdefault(k, []).append(base)
            per.setdefault(k, []).append(int(counts[k]))
            taken[k] += int(counts[k]) * times
        base += times
    return {k: (np.array(begin[k]), np.array(first[k]), np.array(per[k])) for k in begin}


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES, text_col: str = "text", id_col: str = "doc_id", length: Column | None = None
) -> DataFrame:
    """A row for each piece: doc_id, piece (from 0), start_token, n_tokens, bin, bin_offset.

    length: the number of tokens, by default that of TOKEN in the text."""
    if capacity % classes:
        raise ValueError("capacity must be a multiple of classes")
    spark = docs.sparkSession
    ship(spark)
    grain = capacity // classes
    counted = checkpoint(
        docs.select(F.col(id_col).alias("doc_id"), (token_count(F.col(text_col)) if length is None else length).cast("bigint").alias("n"))
    )
    piece = F.expr(f"explode(sequence(0L, greatest((n + {capacity} - 1) div {capacity} - 1, 0))) as piece")
    pieces = counted.select("doc_id", "n", piece).select(
        "doc_id",
        "piece",
        (F.col("piece") * capacity).alias("start_token"),
        F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("n_tokens"),
    ).withColumn("class", F.expr(f"cast((n_tokens + {grain} - 1) div {grain} as int)"))
    histogram = {r["class"]: r["count"] for r in pieces.groupBy("class").count().collect() if r["class"]}
    bins, _ = plan_bins(histogram, classes)
    intervals = rank_intervals(bins, classes)

    @F.pandas_udf("bigint")
    def bin_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for kinds, ranks in batches:
            out = np.zeros(len(kinds), np.int64)
            k, r = kinds.to_numpy(), ranks.to_numpy()
            for one in np.unique(k):
                here = k == one
                begin, first, per = intervals[int(one)]
                at = np.searchsorted(begin, r[here] - 1, side="right") - 1
                out[here] = first[at] + (r[here] - 1 - begin[at]) // per[at]
            yield pd.Series(out)

    ranked = prefix_sum(pieces.filter("class > 0"), "class", "doc_id", [F.col("piece"), F.col("n_tokens")], F.lit(1), "rank")
    placed = ranked.withColumn("bin", bin_of("class", "rank"))
    inside = Window.partitionBy("bin").orderBy(F.desc("n_tokens"), "doc_id", "piece").rowsBetween(Window.unboundedPreceding, 0)
    columns = ["doc_id", "piece", "start_token", "n_tokens", "bin"]
    packed = placed.withColumn("bin_offset", (F.sum("n_tokens").over(inside) - F.col("n_tokens")).cast("int")).select(*columns, "bin_offset")
    empty = pieces.filter("class = 0").select(*columns[:4], F.lit(None).cast("bigint").alias("bin"), F.lit(None).cast("int").alias("bin_offset"))
    return packed.unionByName(empty)
