"""What the operators of this subpackage share: tables, buckets, chunks and prefix sums."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.runtime import shared_dir, shared_path, ship

__all__ = ["shared_dir", "shared_path", "ship"]

#: Rows of a chunk in a two-level prefix sum; a chunk is what one task sorts.
CHUNK_ROWS = 4096
#: Chunks that the driver finds bounds for at most, and how many sampled keys it uses for each (8 bytes a key).
CHUNKS, CHUNK_SAMPLE = 1 << 16, 16


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage with a copy in the shared folder, which outlives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_count(df: DataFrame, growth: float, bucket_bytes: int = 64 << 20, most: int = 1 << 16) -> int:
    """How many buckets the rows that are made of a table go to: three for each shuffle partition, and more where the files that
    it is read from say that `growth` times their size would make buckets of more than `bucket_bytes`."""
    least = 3 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size if size < 1 << 60 else 0  # what Spark says where it doesn't know
    return min(most, max(least, int(known * growth) // bucket_bytes))


def shielded(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The table with its columns that begin with two underscores renamed, as operators call their own such, and what gives
    them their names back."""
    names = {c: f"own{k}_{c.strip('_')}" for k, c in enumerate(docs.columns) if c.startswith("__")}
    back = {v: k for k, v in names.items()}
    return docs.withColumnsRenamed(names), lambda df: df.withColumnsRenamed(back)


def hash_unit(text: Column, modulus: int) -> Column:
    """A pseudo-random integer below modulus (at most 2**32) that is the same in any engine with MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % F.lit(modulus)


def chunked(df: DataFrame, key: str, chunk: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds an order-preserving chunk number of the integer key; null keys are in chunk -1, before all others.

    The bounds are quantiles of sampled keys, so that chunks hold about so many rows (or a `CHUNKS`-th of all, if that is more)
    however the keys are spread; only the balance depends on the sample, not the result."""
    keys = df.select(F.col(key).cast("double").alias("k")).filter("k is not null")
    n = keys.count()
    n_chunks = min(CHUNKS, -(-n // rows))
    cuts = np.zeros(0)
    if n_chunks > 1:
        share = min(1.0, CHUNK_SAMPLE * n_chunks / n)
        sampled = np.sort((keys if share == 1 else keys.sample(share, 1)).toPandas()["k"].to_numpy())
        cuts = np.unique(sampled[len(sampled) * np.arange(1, n_chunks) // n_chunks]) if len(sampled) else cuts
    if not len(cuts):
        return df.withColumn(chunk, F.when(F.col(key).isNull(), -1).otherwise(0).cast("bigint"))
    double, number = f"{chunk}_d", f"{chunk}_n"
    bucketizer = Bucketizer(splits=[-math.inf, *cuts.tolist(), math.inf], inputCol=double, outputCol=number)
    found = bucketizer.transform(df.withColumn(double, F.coalesce(F.col(key).cast("double"), F.lit(0.0))))
    return found.withColumn(chunk, F.when(F.col(key).isNull(), -1).otherwise(F.col(number)).cast("bigint")).drop(double, number)


def prefix_sum(
    df: DataFrame,
    group: str,
    key: str,
    ties: Sequence[Column],
    value: Column,
    out: str,
    per_group: DataFrame | None = None,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Adds the inclusive running sum of value within group in order of key, without one task per group.

    Rows are cut into chunks of the key's range, running sums are taken inside each (group, chunk) and the sums of the
    chunks before are added.  The rows are shuffled once, by (group, chunk).  Group must not be null.  per_group: a table
    of group and more columns, which are added as well; it is joined with the sums of the chunks, not with the rows."""
    chunk, inner, before = (f"__{out}_{x}" for x in ("chunk", "inner", "before"))
    g, c = f"__{out}_g", f"__{out}_c"
    cut = chunked(df, key, chunk, rows)
    order = Window.partitionBy(g).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(F.col(group).alias(g), F.col(chunk).alias(c))
        .agg(F.sum(value).alias(before))
        .withColumn(before, F.coalesce(F.sum(before).over(order), F.lit(0)))
    )
    if per_group is not None:
        offsets = offsets.join(per_group.withColumnRenamed(group, g), g)
    running = Window.partitionBy(group, chunk).orderBy(F.col(key).asc_nulls_first(), *ties)
    summed = cut.withColumn(inner, F.sum(value).over(running.rowsBetween(Window.unboundedPreceding, 0)))
    joined = summed.join(offsets, (F.col(group) == F.col(g)) & (F.col(chunk) == F.col(c)))
    return joined.withColumn(out, F.col(inner) + F.col(before)).drop(chunk, inner, before, g, c)
