"""The data model: documents, corpora, spans and their attributes as DataFrames, and how the given tables map onto it."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.analysis import scan
from spanforge.functions.text import MARKED, PLAIN, STEM_PATTERN, sort_key

DOCUMENT_PRIVILEGED = ("author", "title", "date_value", "sort_key", "source", "profile_id")
SPAN_PRIVILEGED = ("id", "document_id", "type", "p1", "p2", "index", "length", "language", "pos", "lemma", "value", "text")
NUMERIC_PRIVILEGED = ("id", "document_id", "p1", "p2", "index", "length", "date_value")

DOCUMENT_DDL = (
    "id bigint, author string, title string, source string, profile_id string, user_id string, date_value double, "
    "sort_key string, last_modified timestamp, content string"
)
SPAN_DDL = (
    "id bigint, document_id bigint, type string, p1 int, p2 int, index int, length int, language string, pos string, "
    "lemma string, value string, text string"
)
ATTRIBUTE_DDL = "span_id bigint, document_id bigint, name string, value string, type int"
DOCUMENT_ATTRIBUTE_DDL = "document_id bigint, name string, value string, type int"
CORPUS_DDL = "id string, title string, description string, user_id string"
DOCUMENT_CORPUS_DDL = "document_id bigint, corpus_id string"
PROFILE_DDL = "id string, content string, type string, user_id string"
WORD_DDL = "id bigint, lemma_id bigint, value string, reversed_value string, language string, pos string, lemma string, count bigint"
LEMMA_DDL = "id bigint, value string, reversed_value string, language string, pos string, count bigint"
WORD_COUNT_DDL = "word_id bigint, lemma_id bigint, doc_attr_name string, doc_attr_value string, count bigint"
LEMMA_COUNT_DDL = "lemma_id bigint, doc_attr_name string, doc_attr_value string, count bigint"
#: Longest values that are stored.
LIMITS = {"author": 200, "title": 500, "source": 500, "profile_id": 50, "sort_key": 500, "name": 100, "value": 500, "text": 1000, "lemma": 500, "pos": 50, "language": 50}

#: A span's id is its document's id times ID_STEP plus ten times its position plus the number of its kind, where that has room: for
#: documents up to ID_DOCUMENTS and positions below ID_STEP / 10.  Otherwise it is a negative hash of the three.
ID_STEP = 1_000_000_000
ID_DOCUMENTS = 9_000_000_000
KINDS = ("tok", "par", "snt")
TEXT, NUMBER = 0, 1
ATTRIBUTE = "attribute_"


def truncated(df: DataFrame) -> DataFrame:
    """Cuts values to their limits, as on ingest."""
    return df.select(*(F.substring(c, 1, LIMITS[c]).alias(c) if c in LIMITS and t == "string" else F.col(c) for c, t in df.dtypes))


@dataclass
class Catalog:
    """All tables of a collection.  Every one is lazy; what a query doesn't touch isn't read.

    The word index (word, lemma and their counts) is there once `words.with_word_index` has made it.

    wide: where an index has them, the spans with a column for each name of an attribute (ATTRIBUTE and the name); these are all
    attributes that there are."""

    document: DataFrame
    document_attribute: DataFrame
    corpus: DataFrame
    document_corpus: DataFrame
    span: DataFrame
    span_attribute: DataFrame
    profile: DataFrame
    word: DataFrame | None = None
    lemma: DataFrame | None = None
    word_count: DataFrame | None = None
    lemma_count: DataFrame | None = None
    wide = None  # no field, as it is no table of its own

    def write(self, path: str, mode: str = "overwrite") -> None:
        """All tables as Parquet, with values cut to their limits.  Spans and attributes stand clustered by document, so scans of few
        documents prune, and spans have Bloom filters of their values, so scans for rare words do; words and lemmata stand in the
        order of their values."""
        for f in fields(self):
            df = getattr(self, f.name)
            if df is None:
                continue
            df = truncated(df)
            if "document_id" in df.columns:
                df = df.repartition("document_id").sortWithinPartitions(*(c for c in ("document_id", "type", "p1") if c in df.columns))
            elif "reversed_value" in df.columns:
                df = df.repartitionByRange("value").sortWithinPartitions("value")
            out = df.write.mode(mode)
            if f.name == "span":
                out = out.option("parquet.bloom.filter.enabled#value", "true")
            out.parquet(f"{path}/{f.name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Catalog:
        """What was written; the word index is None if there was none."""
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = {x.getPath().getName() for x in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)}
        return cls(*(spark.read.parquet(f"{path}/{f.name}") if f.name in there else None for f in fields(cls)))

    @classmethod
    def empty(cls, spark: SparkSession) -> Catalog:
        ddls = (DOCUMENT_DDL, DOCUMENT_ATTRIBUTE_DDL, CORPUS_DDL, DOCUMENT_CORPUS_DDL, SPAN_DDL, ATTRIBUTE_DDL, PROFILE_DDL, WORD_DDL, LEMMA_DDL, WORD_COUNT_DDL, LEMMA_COUNT_DDL)
        return cls(*(spark.createDataFrame([], d) for d in ddls))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def span_id(document_id: Column, position: Column, kind: str | int) -> Column:
    number = KINDS.index(kind) if isinstance(kind, str) else kind
    room = document_id.between(0, ID_DOCUMENTS) & (position < ID_STEP // 10) & F.lit(number < 10)
    hashed = F.xxhash64(document_id.cast("bigint"), position.cast("bigint"), F.lit(number)).bitwiseOR(F.lit(-(1 << 63)))
    return F.when(room, document_id * F.lit(ID_STEP) + position.cast("bigint") * 10 + number).otherwise(hashed)


def documents(spark: SparkSession, sf_dir: str, content: bool = True) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    title, date = F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), F.col("n_chars").cast("double")
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("author"),
        title.alias("title"),
        "source",
        F.concat(F.lit("prose-"), F.coalesce("lang", F.lit("und"))).alias("profile_id"),
        F.lit(None).cast("string").alias("user_id"),
        date.alias("date_value"),
        sort_key(F.col("source"), title, date).alias("sort_key"),
        F.lit(None).cast("timestamp").alias("last_modified"),
        *([F.col("text").alias("content")] if content else []),
    )


def document_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang and n_chars of all documents, quality and toxic of the labelled ones."""

    def attribute(df: DataFrame, name: str, kind: int) -> DataFrame:
        return df.filter(F.col(name).isNotNull()).select(
            F.col("doc_id").alias("document_id"), F.lit(name).alias("name"), F.col(name).cast("string").alias("value"), F.lit(kind).alias("type")
        )

    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    parts = [attribute(d, "lang", TEXT), attribute(d, "n_chars", NUMBER), attribute(labels, "quality", NUMBER), attribute(labels, "toxic", NUMBER)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def document_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus for each language and for each source."""
    d = table(spark, sf_dir, "documents")
    both = F.explode(F.array(F.concat(F.lit("lang-"), F.lower("lang")), F.concat(F.lit("src-"), F.lower("source"))))
    return d.select(F.col("doc_id").alias("document_id"), both.alias("corpus_id")).filter("corpus_id is not null")


def token_spans(spark: SparkSession, sf_dir: str, offsets: bool = False) -> DataFrame:
    """Tokens, with their character offsets if these are asked for; there is no shuffle."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    t = scan.tokens(d, "doc_id", "text", ("lang",), ("position", *(["index"] if offsets else []), "length", "raw", "value", "pos", "lemma"))
    if not offsets:
        t = t.withColumn("index", F.lit(0))
    return t.select(
        span_id(F.col("doc_id"), F.col("position"), "tok").alias("id"),
        F.col("doc_id").alias("document_id"),
        F.lit("tok").alias("type"),
        F.col("position").alias("p1"),
        F.col("position").alias("p2"),
        "index",
        "length",
        F.col("lang").alias("language"),
        "pos",
        "lemma",
        "value",
        F.col("raw").alias("text"),
    )


def structure_spans(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Paragraphs ('par', the lines of a text) or sentences ('snt', up to a token that ends in . ? ! or ;), of those that have tokens."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = scan.structures(d, "doc_id", "text", ("lang",), {"par": "line", "snt": "sentence"}[kind])
    none = F.lit(None).cast("string")
    length = (F.col("end") - F.col("index")).cast("int")
    return found.select(
        span_id(F.col("doc_id"), F.col("p1"), kind).alias("id"),
        F.col("doc_id").alias("document_id"),
        F.lit(kind).alias("type"),
        "p1",
        "p2",
        "index",
        length.alias("length"),
        F.col("lang").alias("language"),
        none.alias("pos"),
        none.alias("lemma"),
        length.cast("string").alias("value"),
        none.alias("text"),
    )


def token_attributes(tokens: DataFrame) -> DataFrame:
    """len of all tokens, and lp and rp of those with punctuation at an edge."""
    left, right = F.regexp_extract("text", r"^([^\p{L}\p{Nd}]*)", 1), F.regexp_extract("text", r"([^\p{L}\p{Nd}]*)$", 1)
    each = F.array(
        F.struct(F.lit("len").alias("name"), F.length("value").cast("string").alias("value"), F.lit(NUMBER).alias("type")),
        F.struct(F.lit("lp").alias("name"), left.alias("value"), F.lit(TEXT).alias("type")),
        F.struct(F.lit("rp").alias("name"), right.alias("value"), F.lit(TEXT).alias("type")),
    )
    return tokens.select(F.col("id").alias("span_id"), "document_id", F.inline(each)).filter("value <> ''")


def structure_attributes(structures: DataFrame) -> DataFrame:
    """n, how many tokens a structure has."""
    size = (F.col("p2") - F.col("p1") + 1).cast("string")
    return structures.select(F.col("id").alias("span_id"), "document_id", F.lit("n").alias("name"), size.alias("value"), F.lit(NUMBER).alias("type"))


def build_catalog(spark: SparkSession, sf_dir: str, structures: tuple[str, ...] = (), offsets: bool = False) -> Catalog:
    """The collection that the given tables make.  structures: the kinds that span and span_attribute hold besides tokens."""
    span = token_spans(spark, sf_dir, offsets)
    attributes = token_attributes(span)
    for kind in structures:
        own = structure_spans(spark, sf_dir, kind)
        span = span.unionByName(own)
        attributes = attributes.unionByName(structure_attributes(own))
    corpora = document_corpora(spark, sf_dir)
    corpus = corpora.select("corpus_id").distinct().select(
        F.col("corpus_id").alias("id"), F.concat(F.lit("Corpus "), "corpus_id").alias("title"), F.lit("").alias("description"), F.lit(None).cast("string").alias("user_id")
    )
    profile = spark.createDataFrame([], PROFILE_DDL)
    return Catalog(documents(spark, sf_dir), document_attributes(spark, sf_dir), corpus, corpora, span, attributes, profile)


# The same tables in DuckDB's SQL, for comparisons.


ATTRIBUTES_SQL = """attr AS (
  SELECT id AS span_id, 'len' AS name, length(value)::VARCHAR AS value FROM tok
  UNION ALL SELECT * FROM (SELECT id, 'lp', regexp_extract(text, '^([^\\p{L}\\p{Nd}]*)', 1) AS v FROM tok) WHERE v <> ''
  UNION ALL SELECT * FROM (SELECT id, 'rp', regexp_extract(text, '([^\\p{L}\\p{Nd}]*)$', 1) AS v FROM tok) WHERE v <> '')"""


def _q(text: str) -> str:
    return text.replace("'", "''")


def normalise_sql(x: str) -> str:
    """Of text that has gone through plain_sql: what normalise_token leaves."""
    return f"lower(regexp_replace({x}, '[^\\p{{L}}\\p{{Nd}}\\p{{Sc}}'']', '', 'g'))"


def plain_sql(x: str) -> str:
    return f"translate({x}, '{_q(MARKED)}', '{_q(PLAIN)}')"


def fast_tokens_sql() -> str:
    """CTE tok without offsets and kinds of structure, of a zip of raw and normalised pieces."""
    return f"""
split AS (
  SELECT doc_id, lang, list_filter(list_zip(string_split_regex(text, '\\s+'),
    list_transform(string_split_regex({plain_sql('text')}, '\\s+'), lambda x: {normalise_sql('x')})), lambda x: x[2] <> '') AS z FROM documents),
tok0 AS (SELECT doc_id, lang, unnest(z) AS t, generate_subscripts(z, 1)::INT AS position FROM split),
tok AS (
  SELECT doc_id * {ID_STEP} + position * 10 AS id, doc_id AS document_id, 'tok' AS type, position AS p1, position AS p2, lang AS language,
    CASE WHEN regexp_matches(t[2], '^\\d+$') THEN 'NUM' END AS pos, regexp_replace(t[2], '{STEM_PATTERN}', '\\1') AS lemma, t[2] AS value, t[1] AS text FROM tok0),
{ATTRIBUTES_SQL}"""


def tokens_sql() -> str:
    """CTEs pieces, tok0 (doc_id, lang, position, index, length, line, sentence, raw, value), tok, par and snt."""
    return f"""
pieces AS (
  SELECT doc_id, lang, line, k, raw, {normalise_sql('plain')} AS value
  FROM (SELECT doc_id, lang, line, unnest(string_split_regex(body, '\\s')) AS raw, unnest(string_split_regex({plain_sql('body')}, '\\s')) AS plain,
      generate_subscripts(string_split_regex(body, '\\s'), 1) AS k
    FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents))),
tok0 AS (
  SELECT doc_id, lang, position::INT AS position, index::INT AS index, length(raw)::INT AS length, line::INT AS line, sentence::INT AS sentence, raw, value
  FROM (SELECT *, sum((value <> '')::INT) OVER w AS position, sum(length(raw) + 1) OVER w - 1 - length(raw) AS index,
      coalesce(sum(regexp_matches(raw, '[.?!;]["\\x{{201d}}\\x{{2019}}\\x{{00bb}})]*$')::INT) OVER (PARTITION BY doc_id ORDER BY line, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS sentence
    FROM pieces WINDOW w AS (PARTITION BY doc_id ORDER BY line, k ROWS UNBOUNDED PRECEDING))
  WHERE value <> ''),
tok AS (
  SELECT doc_id * {ID_STEP} + position * 10 AS id, doc_id AS document_id, 'tok' AS type, position AS p1, position AS p2, index, length, lang AS language,
    CASE WHEN regexp_matches(value, '^\\d+$') THEN 'NUM' END AS pos, regexp_replace(value, '{STEM_PATTERN}', '\\1') AS lemma, value, raw AS text FROM tok0),
par AS (
  SELECT doc_id * {ID_STEP} + min(position) * 10 + 1 AS id, doc_id AS document_id, 'par' AS type, min(position) AS p1, max(position) AS p2, min(index) AS index,
    (max(index + length) - min(index))::INT AS length, (max(index + length) - min(index))::VARCHAR AS value FROM tok0 GROUP BY doc_id, line),
snt AS (
  SELECT doc_id * {ID_STEP} + min(position) * 10 + 2 AS id, doc_id AS document_id, 'snt' AS type, min(position) AS p1, max(position) AS p2, min(index) AS index,
    (max(index + length) - min(index))::INT AS length, (max(index + length) - min(index))::VARCHAR AS value FROM tok0 GROUP BY doc_id, sentence),
{ATTRIBUTES_SQL}"""


def document_attributes_sql() -> str:
    parts = [f"SELECT doc_id AS document_id, '{n}' AS name, {n}::VARCHAR AS value FROM {t} WHERE {n} IS NOT NULL" for n, t in (("lang", "documents"), ("n_chars", "documents"), ("quality", "labels"), ("toxic", "labels"))]
    return "doc_attr AS (" + " UNION ALL ".join(parts) + ")"
