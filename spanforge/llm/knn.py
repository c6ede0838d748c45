"""Exact top-k search with vector-approximation files.

Each dimension is cut into 256 equal cells between its least and largest value in the table, and a vector is approximated by the
middles of its cells, a byte for each dimension.  With the distance r between a vector and its approximation, the distance from a
query lies between that to the approximation less r and that plus r.

The approximations, in blocks that make up strips, meet the queries, in blocks; exact vectors don't travel to that scan.  A task
scans the cells of a strip for the bounds of its queries and returns those vectors whose lower bound doesn't exceed the k-th least
upper bound that the query has in the strip.  Over all strips the k-th least upper bound of a query rules out most of these.  The
exact vectors of the rest are fetched by one join on the id, and in the order of their lower bounds they are compared until the next
bound exceeds the k-th distance.  Distances are Euclidean; equal ones rank by id.

The work of the scan is queries x vectors, as there is no index; what travels is a byte a dimension for each block of queries.

Defined cases: a query is not its own neighbour, but other vectors of the same id are (repeated rows are vectors each);
null ids and null vectors, vectors of other lengths than the most common (the longest of those equally common), and vectors that
have null or non-finite values are neither queries nor neighbours; with fewer than k others there are fewer results; an
empty table, or one without queries, gives an empty one; other columns aren't read.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import checkpoint, ship

K = 10
CELLS = 256
#: Vectors of a block of cells, of a strip of such blocks, and of a block of queries.
BLOCK, STRIP, QUERIES = 1 << 13, 1 << 20, 1 << 14
#: Queries of a block whose bounds are held at once.
TILE = 512


class Grid:
    """Cells between the least and the largest value of each dimension."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low, self.width = low, np.maximum((high - low) / CELLS, 1e-300)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return np.clip((vectors - self.low) / self.width, 0, CELLS - 1).astype(np.uint8)

    def middles(self, cells: np.ndarray) -> np.ndarray:
        return self.low + (cells + 0.5) * self.width

    def errors(self, vectors: np.ndarray, cells: np.ndarray) -> np.ndarray:
        return np.linalg.norm(vectors - self.middles(cells), axis=1) * (1 + 1e-12)


def bounds(queries: np.ndarray, middles: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances, queries x vectors, from the approximations alone."""
    centre = middles.mean(axis=0)  # around it little is lost in the difference of squares
    x, q = middles - centre, queries - centre
    xx, qq = (x * x).sum(axis=1), (q * q).sum(axis=1)
    square = qq[:, None] + xx - 2 * (q @ x.T)
    slack = 1e-12 * (qq[:, None] + xx)
    low = np.sqrt(np.maximum(square - slack, 0)) - error
    return np.maximum(low, 0), np.sqrt(np.maximum(square, 0) + slack) + error


def scan(q: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], grid: Grid, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Row of the query, id of the vector, lower and upper bound of what the bounds don't rule out; blocks: (ids, cells, errors)."""
    for a in range(0, len(q), TILE):
        part = q[a : a + TILE]
        best = np.full((len(part), k), np.inf)
        found: list[tuple[np.ndarray, ...]] = []
        for ids, cells, error in blocks:
            low, high = bounds(part, grid.middles(cells), error)
            most = np.partition(high, k - 1, axis=1)[:, :k] if high.shape[1] > k else high
            best = np.sort(np.concatenate([best, most], axis=1), axis=1)[:, :k]
            row, column = np.nonzero(low <= best[:, -1:])
            found.append((row, ids[column], low[row, column], high[row, column]))
        row, ids, low, high = (np.concatenate(x) for x in zip(*found))
        keep = low <= best[row, -1]
        yield row[keep] + a, ids[keep], low[keep], high[keep]


def read_in_order(query: np.ndarray, vectors: np.ndarray, low: np.ndarray, k: int, step: int = 16) -> np.ndarray:
    """Distances from a query to vectors that stand in the order of their lower bounds; those that needn't be read are infinite."""
    out = np.full(len(vectors), np.inf)
    for at in range(0, len(vectors), step):
        if at >= k and low[at] > np.partition(out[:at], k - 1)[k - 1]:
            break
        out[at : at + step] = np.sqrt(((vectors[at : at + step] - query) ** 2).sum(axis=1))
    return out


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(
    vectors: DataFrame, k: int = K, is_query: Column | None = None, block: int = BLOCK, strip: int = STRIP, queries: int = QUERIES,
    vector_col: str = "embedding", id_col: str = "vec_id",
) -> DataFrame:
    """Rows (query_id, rank, neighbor_id, distance), ranks from 1 to k, of the rows for which is_query holds (all by default)."""
    spark = vectors.sparkSession
    ship(spark)
    valid = F.col("v").isNotNull() & F.col("id").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    asked = F.lit(True) if is_query is None else F.coalesce(is_query, F.lit(False))
    narrow = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"), asked.alias("q")).filter(valid)
    lengths = narrow.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("q").cast("int")).alias("q")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None or not lengths["d"] or not lengths["q"]:
        return spark.createDataFrame([], "query_id bigint, rank int, neighbor_id bigint, distance double")
    narrow = narrow.filter(F.size("v") == lengths["d"])

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column(0))
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if low is not None:
            yield pa.record_batch({"k": np.arange(len(low)), "low": low, "high": high})

    sides = narrow.select("v").mapInArrow(extremes, "k bigint, low double, high double").groupBy("k").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("k").toPandas()
    grid = Grid(sides["low"].to_numpy(), sides["high"].to_numpy())

    # enough tasks for all cores, as long as a strip has more than a few vectors
    n_queries = max(1, math.ceil(lengths["q"] / queries))
    n_strips = max(1, math.ceil(lengths["n"] / strip), min(math.ceil(4 * spark.sparkContext.defaultParallelism / n_queries), lengths["n"] // 1024))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x, to = batch.column(0).to_numpy(), _vectors(batch.column(1)), batch.column(2).to_numpy()
            c = grid.cells(x)
            error = grid.errors(x, c)
            for number in np.unique(to).tolist():
                here = to == number
                payload = pickle.dumps((ids[here], c[here], error[here]), 5)
                yield pa.record_batch({"side": pa.array([1], pa.int32()), "strip": pa.array([number], pa.int32()), "payload": pa.array([payload], pa.binary())})

    cells = narrow.select("id", "v", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(n_strips)).cast("int").alias("strip")).mapInArrow(encode, "side int, strip int, payload binary")
    asking = checkpoint(narrow.filter("q").select("id", "v").withColumn("place", F.monotonically_increasing_id()))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, x, to = batch.column(0).to_numpy(), _vectors(batch.column(1)), batch.column(2).to_numpy()
            for b in np.unique(to).tolist():
                here = np.flatnonzero(to == b)
                yield pa.record_batch({"side": pa.array([0], pa.int32()), "block": pa.array([b], pa.int32()), "payload": pa.array([pickle.dumps((places[here], x[here]), 5)], pa.binary())})

    number = F.pmod(F.xxhash64("place"), F.lit(n_queries)).cast("int")
    asked_blocks = asking.select("place", "v", number.alias("block")).mapInArrow(gather, "side int, block int, payload binary")
    every_strip = F.explode(F.sequence(F.lit(0), F.lit(n_strips - 1)))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1)))
    meeting = asked_blocks.select("side", "block", every_strip.alias("strip"), "payload").unionByName(cells.select("side", every_block.alias("block"), "strip", "payload"))

    def search(table: pa.Table) -> pa.Table:
        own: dict[int, list] = {0: [], 1: []}
        for side, payload in zip(table.column("side").to_pylist(), table.column("payload").to_pylist()):
            own[side].append(pickle.loads(payload))
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]]
        if own[0] and own[1]:
            places, q = (np.concatenate(x) for x in zip(*own[0]))
            ids, c, error = (np.concatenate(x) for x in zip(*own[1]))
            parts = [(ids[a : a + block], c[a : a + block], error[a : a + block]) for a in range(0, len(ids), block)]
            for row, *rest in scan(q, parts, grid, k + 1):  # one more, as the query itself is among the vectors
                for column, values in zip(out, (places[row], *rest)):
                    column.append(values)
        return pa.table(dict(zip(("place", "neighbor_id", "low", "high"), (np.concatenate(x) for x in out))))

    found = meeting.groupBy("block", "strip").applyInArrow(search, "place bigint, neighbor_id bigint, low double, high double")
    by_high = F.row_number().over(Window.partitionBy("place").orderBy("high"))
    certain = F.max(F.when(F.col("n") <= k + 1, F.col("high"))).over(Window.partitionBy("place"))
    left = found.withColumn("n", by_high).withColumn("certain", certain).filter("low <= certain").groupBy("place", "neighbor_id").agg(F.min("low").alias("low"))
    exact = left.join(narrow.select(F.col("id").alias("neighbor_id"), F.col("v").alias("other")), "neighbor_id")
    # a query's candidates stand together, in the order of their lower bounds
    exact = exact.join(asking.select("place", F.col("id").alias("query_id"), "v"), "place").repartition("place").sortWithinPartitions("place", "low", "neighbor_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            place, low = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            x, q = _vectors(batch.column(4)), _vectors(batch.column(5))
            cut = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            d = np.concatenate([read_in_order(q[a], x[a:z], low[a:z], k + 1) for a, z in zip(cut, np.append(cut[1:], len(place)))])
            read = pa.array(np.isfinite(d))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(d)], ["place", "query_id", "neighbor_id", "distance"]).filter(read)

    compared = exact.select("place", "query_id", "neighbor_id", "low", "other", "v").mapInArrow(compare, "place bigint, query_id bigint, neighbor_id bigint, distance double")
    w = Window.partitionBy("place")
    ranked = compared.withColumn("n", F.row_number().over(w.orderBy("distance", "neighbor_id")))
    itself = F.min(F.when((F.col("neighbor_id") == F.col("query_id")) & (F.col("distance") == 0), F.col("n"))).over(w)
    ranked = ranked.withColumn("own", F.coalesce(itself, F.lit(1 << 30))).filter("n <> own")
    rank = (F.col("n") - (F.col("n") > F.col("own")).cast("int")).cast("int")
    return ranked.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")


def oracle(table: str = "embeddings", k: int = K, is_query: str = "a.vec_id % 20 = 0") -> str:
    """The same result by comparing the queries with all vectors, in DuckDB's SQL."""
    return f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM {table}),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id,
    sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance
    FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE {is_query}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, neighbor_id, round(distance, 6) AS distance FROM r WHERE rank <= {k}
"""
