"""Sharding by sampled splitters.

Records are drawn with a chance in proportion to their size, the quantiles of the drawn keys become the boundaries of
ranges, and records go to the range of their key.  A range that turned out larger than `slack` times the target is
cut into equal parts along the order of its records, so heavy or repeated keys do no harm.  There are at most `RANGES` ranges; of
larger inputs all of them are cut so.

The key is the source and then the document id, so shards are runs of documents of one source where sources are large.
Defined cases: null sources, ids and texts are allowed (null sources sort before empty ones, null ids first, null texts have size 0);
rows of the same key follow the order of their texts; an empty table gives an empty table; all columns are kept
and a column that has the name of the added one is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import hash_unit, shielded, ship

TARGET = 1 << 20
OVERSAMPLE = 16
SLACK = 1.25
#: Ranges that the driver finds splitters for; it holds `OVERSAMPLE` keys for each.
RANGES = 1 << 16
_BIAS = 1 << 63


def shard_key(source_col: str = "source", id_col: str = "doc_id") -> Column:
    """A string whose order is that of (source, id)."""
    number = F.lpad((F.col(id_col).cast("decimal(20,0)") + F.lit(str(_BIAS)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.concat(F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")), F.lit("\x01"), F.coalesce(number, F.lit("")))


def shard_documents(
    docs: DataFrame,
    target: int = TARGET,
    oversample: int = OVERSAMPLE,
    slack: float = SLACK,
    shard_col: str = "shard",
    text_col: str = "text",
    source_col: str = "source",
    id_col: str = "doc_id",
    ranges: int = RANGES,
) -> DataFrame:
    """The documents with the number of their shard; numbers rise with the key.

    target: characters of a shard.  The driver holds about `oversample` keys for each of at most `ranges` ranges, nothing else."""
    ship(docs.sparkSession)
    docs, restored = shielded(docs)
    kept = [c for c in docs.columns if c != shard_col]
    keyed = docs.select(
        *kept,
        shard_key(source_col, id_col).alias("__key"),
        F.coalesce(F.char_length(F.col(text_col)), F.lit(0)).cast("bigint").alias("__size"),
    )
    total = int(keyed.agg(F.sum("__size")).first()[0] or 0)
    n_ranges = min(ranges, max(1, math.ceil(total / target)))
    step = max(1, total // (n_ranges * oversample))
    # a record is drawn once for every `step` of its size, and once more with the chance that the rest of it has
    draws = F.expr("cast((__size + __u) div __step as bigint)")
    sampled = (
        keyed.select("__key", "__size", hash_unit(F.col("__key"), 1 << 31).alias("__h"), F.lit(step).alias("__step"))
        .withColumn("__u", F.expr("__h % __step"))
        .select("__key", draws.alias("draws"))
        .filter("draws > 0")
        .toPandas()
    )
    cuts = np.zeros(0, object)
    if n_ranges > 1 and len(sampled):
        sampled = sampled.groupby("__key", as_index=False)["draws"].sum().sort_values("__key")
        reached = sampled["draws"].to_numpy().cumsum()
        goals = [j * int(reached[-1]) // n_ranges for j in range(1, n_ranges)]
        cuts = np.unique(sampled["__key"].to_numpy(object)[np.searchsorted(reached, goals, side="left")])

    shared = docs.sparkSession.sparkContext.broadcast(cuts)

    @F.pandas_udf("bigint")
    def range_of(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for k in keys:
            yield pd.Series(np.searchsorted(shared.value, k.to_numpy(object), side="left"))

    ranged = keyed.withColumn("__range", range_of("__key"))
    limit = int(target * slack)
    parts = (
        ranged.groupBy("__range")
        .agg(F.sum("__size").alias("__total"))
        .withColumn("__parts", F.when(F.col("__total") > limit, F.expr(f"(__total + {target} - 1) div {target}")).otherwise(F.lit(1)))
        .withColumn("__first", F.coalesce(F.sum("__parts").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumnRenamed("__range", "__r")
    )
    running = (
        Window.partitionBy("__range").orderBy("__key", F.col(text_col).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = ranged.withColumn("__cum", F.sum("__size").over(running)).join(parts, F.col("__range") == F.col("__r"))
    part = F.expr("least(((__cum - __size) * __parts) div greatest(__total, 1), __parts - 1)")
    return restored(placed.select(*kept, (F.col("__first") + part).cast("bigint").alias(shard_col)))


def oracle(docs: str = "documents", target: int = TARGET, ranges: int = RANGES) -> str:
    """The same shards, with default parameters, in DuckDB's SQL over a table of documents."""
    limit = int(target * SLACK)
    return f"""
WITH d AS (SELECT *, coalesce(length(text), 0)::BIGINT AS z, coalesce('s' || source, 'n') || chr(1) ||
        coalesce(lpad((doc_id::HUGEINT + {_BIAS}::HUGEINT)::VARCHAR, 20, '0'), '') AS k FROM {docs}),
t AS (SELECT n, greatest(1, total // (n * {OVERSAMPLE})) AS step FROM (
    SELECT total, least({ranges}, greatest(1, (total + {target} - 1) // {target})) AS n
    FROM (SELECT coalesce(sum(z), 0)::BIGINT AS total FROM d))),
s AS (SELECT k, sum(draws) AS draws FROM (
    SELECT k, (z + (('0x' || substr(md5(k), 1, 8))::BIGINT % {1 << 31}) % step) // step AS draws FROM d, t)
    WHERE draws > 0 GROUP BY k),
r AS (SELECT k, sum(draws) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS reached, sum(draws) OVER () AS whole FROM s),
g AS (SELECT j, n FROM t, range(1, n) AS x(j)),
cuts AS (SELECT DISTINCT (SELECT min(k) FROM r WHERE reached >= (g.j * r.whole) // g.n) AS cut FROM g),
e AS (SELECT d.*, (SELECT count(*) FROM cuts WHERE cut < d.k) AS rng FROM d),
p AS (SELECT rng, total, parts, coalesce(sum(parts) OVER (ORDER BY rng ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
    FROM (SELECT rng, sum(z)::BIGINT AS total,
        CASE WHEN sum(z) > {limit} THEN (sum(z)::BIGINT + {target} - 1) // {target} ELSE 1 END AS parts FROM e GROUP BY rng)),
c AS (SELECT e.*, (sum(z) OVER (PARTITION BY rng ORDER BY k, text NULLS FIRST ROWS UNBOUNDED PRECEDING))::BIGINT AS cum FROM e)
SELECT doc_id, text, lang, source, n_chars,
    (first + least(((cum - z) * parts) // greatest(total, 1), parts - 1))::BIGINT AS shard
FROM c JOIN p USING (rng)
"""
