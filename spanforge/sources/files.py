"""Sources and sinks: text files, companion tables of attributes, token caches, exports."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.model import Catalog


def collect_files(spark: SparkSession, path: str, mask: str = "*", recursive: bool = True) -> DataFrame:
    """Names of files in order of their code points; no contents are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", mask).option("recursiveFileLookup", recursive).load(path)
    return files.select(F.col("path").alias("source"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified")).orderBy("source")


def read_texts(spark: SparkSession, path: str, mask: str = "*", recursive: bool = True, find: str | None = None, replace: str = "") -> DataFrame:
    """(source, content), a row for each file; find and replace change the source's name."""
    texts = spark.read.option("pathGlobFilter", mask).option("recursiveFileLookup", recursive).text(path, wholetext=True)
    source = F.col("_metadata.file_path")
    return texts.select((F.regexp_replace(source, find, replace) if find else source).alias("source"), F.col("value").alias("content"))


def read_table_texts(spark: SparkSession, url: str, table: str = "document", properties: Mapping[str, str] | None = None) -> DataFrame:
    """(id, content) from a database, where a JDBC driver for it is at hand."""
    return spark.read.jdbc(url, table, properties=dict(properties or {})).select("id", "content")


def _long_attributes(rows: DataFrame, name_col: str, value_col: str, names: Mapping[str, str] | None) -> DataFrame:
    """(source, name, value, type): names may be mapped to others, and one that ends with # means numbers."""
    name = F.trim(name_col)
    for old, new in (names or {}).items():
        name = F.when(F.trim(name_col) == old, F.lit(new)).otherwise(name)
    return rows.select("source", F.regexp_replace(name, "#$", "").alias("name"), F.trim(value_col).alias("value"), F.when(name.endswith("#"), 1).otherwise(0).alias("type")).filter("name <> '' and value is not null")


def read_csv_attributes(
    spark: SparkSession, path: str, suffix: str = r"\.csv$", to: str = ".txt", name_col: str = "name", value_col: str = "value", names: Mapping[str, str] | None = None, delimiter: str = ","
) -> DataFrame:
    """Attributes from a CSV file beside each document: the file's name, with suffix replaced, is the document's source."""
    rows = spark.read.option("header", True).option("sep", delimiter).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path)
    rows = rows.withColumn("source", F.regexp_replace("_metadata.file_path", suffix, to))
    return _long_attributes(rows, name_col, value_col, names)


def read_sheet_attributes(spark: SparkSession, paths: Mapping[str, str], sheet: int | str = 0, name_col: str = "name", value_col: str = "value", names: Mapping[str, str] | None = None) -> DataFrame:
    """The same from spreadsheets (source -> path), for which pandas needs a reader of the format."""
    parts = []
    for source, path in paths.items():
        df = pd.read_excel(path, sheet_name=sheet, dtype=str)[[name_col, value_col]]
        df["source"] = source
        parts.append(df)
    rows = spark.createDataFrame(pd.concat(parts)) if parts else spark.createDataFrame([], f"{name_col} string, {value_col} string, source string")
    return _long_attributes(rows, name_col, value_col, names)


def join_attributes(documents: DataFrame, attributes: DataFrame) -> DataFrame:
    """(document_id, name, value, type) for the documents (id, source) that attributes by source belong to."""
    return documents.select(F.col("id").alias("document_id"), "source").join(attributes, "source").select("document_id", "name", "value", "type")


# token caches


def write_token_cache(tokens: DataFrame, attributes: DataFrame, path: str) -> None:
    """Tokens with their attributes as a map, clustered and sorted by document, so that a document's tokens lie together."""
    by = attributes.groupBy("span_id").agg(F.map_from_entries(F.collect_set(F.struct("name", "value"))).alias("attributes"))
    rows = tokens.join(by, tokens["id"] == by["span_id"], "left").select("document_id", F.col("p1").alias("position"), "index", "length", "value", "text", "attributes")
    rows.repartition("document_id").sortWithinPartitions("document_id", "position").write.mode("overwrite").parquet(path)


def read_token_cache(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, position, name, value)."""
    return spark.read.parquet(path).select("document_id", "position", F.explode("attributes").alias("name", "value"))


def write_tagger_input(tokens: DataFrame, path: str) -> None:
    """Tokens for a tagger outside, tab-separated: document, position, value, index, length, original text."""
    rows = tokens.select("document_id", "p1", "value", "index", "length", "text").repartition("document_id").sortWithinPartitions("document_id", "p1")
    rows.write.mode("overwrite").option("sep", "\t").csv(path)


# exports


def dump_spans(catalog: Catalog, path: str, kind: str | None = None, document_id: int | None = None, with_attributes: bool = True) -> None:
    """Spans as CSV, a row for each attribute (at_n, at_v) if they are asked for."""
    span_rows(catalog, kind, document_id, with_attributes).write.mode("overwrite").option("header", True).csv(path)


def span_rows(catalog: Catalog, kind: str | None = None, document_id: int | None = None, with_attributes: bool = True) -> DataFrame:
    spans = catalog.span
    if kind is not None:
        spans = spans.filter(F.col("type") == kind)
    if document_id is not None:
        spans = spans.filter(F.col("document_id") == document_id)
    if not with_attributes:
        return spans
    own = catalog.span_attribute.select(F.col("span_id").alias("id"), F.col("name").alias("at_n"), F.col("value").alias("at_v"))
    return spans.join(own, "id", "left")


def write_word_report(checked: DataFrame, path: str) -> None:
    checked.write.mode("overwrite").option("header", True).csv(path)
