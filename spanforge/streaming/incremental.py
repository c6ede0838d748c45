"""Incremental indexing: new or changed files become spans, and a document that comes again replaces what it had.

Spans are stored in folders by a bucket of the document's source; a batch rewrites only the buckets that its documents are in.  A
batch that runs twice leaves the same rows, as ids depend on sources and positions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanforge.analysis.tokens import full_tokens
from spanforge.runtime import delete

BUCKETS = 64


def document_key(source: Column) -> Column:
    return F.pmod(F.xxhash64(source), F.lit(1 << 53))


def index_documents(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Token spans of (source, content[, modified]) rows; of rows of the same source the latest counts."""
    order = [F.col("modified").desc()] if "modified" in docs.columns else []
    latest = Window.partitionBy("source").orderBy(*order, F.col("content").desc())
    last = docs.withColumn("__k", F.row_number().over(latest)).filter("__k = 1")
    keyed = last.select(document_key(F.col("source")).alias("document_id"), "source", "content")
    t = full_tokens(keyed, "document_id", "content", "source")
    return t.select("document_id", "source", F.col("position").alias("p1"), F.col("position").alias("p2"), "index", "length", "value", F.col("raw").alias("text"), F.pmod(F.col("document_id"), F.lit(buckets)).cast("int").alias("bucket"))


def merge_batch(spark: SparkSession, docs: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Replaces the spans of the batch's documents, also of those that have no tokens left."""
    docs = docs.persist()
    try:
        touched = docs.select(document_key(F.col("source")).alias("document_id")).distinct().withColumn("bucket", F.pmod("document_id", F.lit(buckets)).cast("int"))
        new = index_documents(docs, buckets)
        numbers = [r["bucket"] for r in touched.select("bucket").distinct().collect()]  # at most as many as there are buckets
        if not numbers:
            return
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        exists = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
        merged = new
        if exists:
            old = spark.read.schema(new.schema).parquet(path).filter(F.col("bucket").isin(*numbers))
            merged = old.join(touched.select("document_id"), "document_id", "left_anti").select(*new.columns).unionByName(new)
        staged = f"{path.rstrip('/')}.staged"
        merged.repartition("bucket").sortWithinPartitions("document_id", "p1").write.mode("overwrite").partitionBy("bucket").parquet(staged)
        rows = spark.read.schema(new.schema).parquet(staged)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        # buckets that come out empty have no rows to overwrite what they had
        left = {r["bucket"] for r in rows.select("bucket").distinct().collect()}
        for b in set(numbers) - left:
            delete(spark, f"{path}/bucket={b}")
        delete(spark, staged)
    finally:
        docs.unpersist()


def start_indexing(spark: SparkSession, folder: str, path: str, checkpoint: str, buckets: int = BUCKETS, once: bool = True) -> StreamingQuery:
    """A stream of text files in a folder into the span table at path; once: what is there now, then it ends."""
    texts = spark.readStream.option("wholetext", True).text(folder)
    docs = texts.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("modified"))
    writer = docs.writeStream.foreachBatch(lambda batch, _: merge_batch(batch.sparkSession, batch, path, buckets)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
