"""Mixing sources to target weights by systematic sampling.

Each document of a source has the same number of expected copies: the share of the total size that its source
should have, over the size that it has.  The expected copies are summed up within the source in order of document id,
one pseudo-random offset per source is added, and a document is emitted once for every whole number that the sum
crosses at it.  So a source has its expected number of copies to within one, and a document to within one.  Copies are
numbered by 64-bit integers, and made in runs of `RUN`, so a source of a few characters may get any number of them.

Defined cases: null sources form one source of their own; null texts have size 0; a source of size 0 (only empty
texts) keeps one copy of each document; weights of sources that aren't named are `default_weight`; null ids come first in
the order and rows of the same id follow the order of their texts; repeated rows count as documents each; an
empty table gives an empty table.  All columns are kept; a column that has the name of the added one is replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import hash_unit, prefix_sum, shielded, ship

#: Expected copies are counted in millionths, so that sums are exact.
UNIT = 1_000_000
SEED = "mix-1"
#: Copies that one array makes.
RUN = 1 << 16


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    default_weight: float = 1.0,
    total_size: int | None = None,
    seed: str = SEED,
    copy_col: str = "copy_no",
    text_col: str = "text",
    source_col: str = "source",
    id_col: str = "doc_id",
) -> DataFrame:
    """The documents of the mixture, each as often as it is drawn, with the number of the copy from 1.

    total_size: characters that the mixture should have, by default those of docs."""
    ship(docs.sparkSession)
    docs, restored = shielded(docs)
    src, size, units, cum = "__mix_source", "__mix_size", "__mix_units", "__mix_cum"
    kept = [c for c in docs.columns if c != copy_col]
    # a prefix tells a null source from an empty one
    marked = docs.select(
        *kept, F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias(src)
    )
    length = F.coalesce(F.char_length(F.col(text_col)), F.lit(0)).cast("bigint")
    weight = F.lit(float(default_weight))
    for name, w in (weights or {}).items():
        weight = F.when(F.col(src) == F.lit("s" + name), F.lit(float(w))).otherwise(weight)
    sizes = marked.groupBy(src).agg(F.sum(length).alias(size)).withColumn("__mix_w", weight)
    whole = sizes.agg(
        F.sum(size).cast("double").alias("__mix_total"),
        F.sum(F.when(F.col(size) > 0, F.col("__mix_w"))).alias("__mix_weights"),
    )
    total = F.col("__mix_total") if total_size is None else F.lit(float(total_size))
    # whole copies and millionths of a copy that each document of a source expects
    rate = total * F.col("__mix_w") / (F.col("__mix_weights") * F.col(size).cast("double"))
    drawn_from = sizes.crossJoin(whole).withColumn("__mix_rate", F.when(F.col(size) > 0, F.when(F.col("__mix_weights") > 0, rate).otherwise(0.0)).otherwise(1.0))
    rates = drawn_from.select(
        src,
        F.floor("__mix_rate").cast("bigint").alias("__mix_full"),
        F.floor((F.col("__mix_rate") - F.floor("__mix_rate")) * F.lit(float(UNIT))).cast("bigint").alias(units),
    )
    # all documents of a source expect the same number of copies, so the sum is their rank times that
    ranked = prefix_sum(marked, src, id_col, [F.col(text_col).asc_nulls_first()], F.lit(1), "__mix_rank", rates)
    summed = ranked.withColumn(cum, F.col("__mix_rank") * F.col(units))
    offset = hash_unit(F.concat(F.lit(seed), F.col(src)), UNIT)
    crossed = F.expr(f"__mix_full + ({cum} + __mix_off) div {UNIT} - ({cum} - {units} + __mix_off) div {UNIT}")
    drawn = summed.withColumn("__mix_off", offset).withColumn("__mix_n", crossed).filter("__mix_n > 0")
    drawn = drawn.select(*kept, "__mix_n", F.explode(F.expr(f"sequence(0L, (__mix_n - 1) div {RUN})")).alias("__mix_run"))
    copy = F.explode(F.expr(f"sequence(__mix_run * {RUN} + 1, least(__mix_n, (__mix_run + 1) * {RUN}))"))
    return restored(drawn.select(*kept, copy.alias(copy_col)))


def oracle(docs: str = "documents") -> str:
    """The same mixture, with default parameters, in DuckDB's SQL over a table of documents."""
    return f"""
WITH d AS (SELECT *, coalesce('s' || source, 'n') AS s, coalesce(length(text), 0)::BIGINT AS z FROM {docs}),
sizes AS (SELECT s, sum(z)::BIGINT AS size FROM d GROUP BY s),
whole AS (SELECT sum(size)::DOUBLE AS total, sum(CASE WHEN size > 0 THEN 1.0::DOUBLE END) AS weights FROM sizes),
rates AS (SELECT s, floor(r)::BIGINT AS f, floor((r - floor(r)) * {float(UNIT)}::DOUBLE)::BIGINT AS u
    FROM (SELECT s, CASE WHEN size > 0 THEN total * 1.0::DOUBLE / (weights * size::DOUBLE) ELSE 1.0::DOUBLE END AS r FROM sizes, whole)),
c AS (SELECT d.*, f, u, (sum(u) OVER (PARTITION BY d.s ORDER BY doc_id NULLS FIRST, text NULLS FIRST
        ROWS UNBOUNDED PRECEDING))::BIGINT AS cum,
    ('0x' || substr(md5('{SEED}' || d.s), 1, 8))::BIGINT % {UNIT} AS o
    FROM d JOIN rates USING (s)),
n AS (SELECT *, f + (cum + o) // {UNIT} - (cum - u + o) // {UNIT} AS n FROM c)
SELECT doc_id, text, lang, source, n_chars, unnest(generate_series(1, n)) AS copy_no FROM n WHERE n > 0
"""
