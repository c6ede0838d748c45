"""Word and lemma index: words, lemmata, their counts by document attributes, browsing and statistics.

Tokens are counted by document and word first, so that what is joined with the documents' attributes is one row for each word of a
document, and the counts by attribute need no tables of ids.  Ids come from the words themselves, not from a global numbering.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.text import only_letters, stable_id, to_number
from spanforge.model import ATTRIBUTE, Catalog

DEFAULT_BINS = {"date_value": 3}
SKIPPED_ATTRIBUTES = ("date",)


def index_tokens(catalog: Catalog, excluded_pos: Sequence[str] = (), excluded_attributes: Sequence[str] = ()) -> DataFrame:
    """Tokens that are indexed: letters alone, with a lemma, of no excluded part of speech and without excluded attributes."""
    t = catalog.span.filter((F.col("type") == "tok") & only_letters(F.col("value")) & F.col("lemma").isNotNull())
    if excluded_pos:
        t = t.filter(F.col("pos").isNull() | ~F.col("pos").isin(*excluded_pos))
    if excluded_attributes:
        bad = catalog.span_attribute.filter(F.lower("name").isin(*(x.lower() for x in excluded_attributes))).select(F.col("span_id").alias("id"))
        t = t.join(bad, "id", "left_anti")
    value, lemma = F.lower("value"), F.lower("lemma")
    return t.select(
        "id",
        "document_id",
        "language",
        "pos",
        value.alias("value"),
        lemma.alias("lemma"),
    )


def word_id() -> Column:
    return stable_id(F.col("language"), F.col("value"), F.col("pos"), F.col("lemma"))


def lemma_id(value: str = "lemma") -> Column:
    return stable_id(F.col("pos"), F.col("language"), F.col(value))


def build_words(tokens: DataFrame, count: Column | None = None) -> DataFrame:
    """id, lemma_id, value, reversed_value, language, pos, lemma, count of each distinct (language, value, pos, lemma).

    count: an aggregate, where rows aren't tokens."""
    counted = tokens.groupBy("language", "value", "pos", "lemma").agg((F.count(F.lit(1)) if count is None else count).alias("count"))
    return counted.select(
        word_id().alias("id"), lemma_id().alias("lemma_id"), "value", F.reverse("value").alias("reversed_value"), "language", "pos", "lemma", "count"
    )


def build_lemmata(words: DataFrame) -> DataFrame:
    """id, value, reversed_value, language, pos, count of each lemma that is letters alone."""
    named = words.filter(only_letters(F.col("lemma"))).withColumn("__lemma", F.lower("lemma"))
    summed = named.groupBy("pos", "language", F.col("__lemma").alias("value")).agg(F.sum("count").alias("count"))
    return summed.select(lemma_id("value").alias("id"), "value", F.reverse("value").alias("reversed_value"), "language", "pos", "count")


def assign_words(spans: DataFrame, words: DataFrame) -> DataFrame:
    """Adds word_id and lemma_id to token spans; language and part of speech match null-safe."""
    w = words.select(F.col("id").alias("word_id"), "lemma_id", *(F.col(c).alias(f"__{c}") for c in ("language", "value", "pos", "lemma")))
    same = (
        F.col("language").eqNullSafe(F.col("__language"))
        & F.col("pos").eqNullSafe(F.col("__pos"))
        & (F.lower("value") == F.col("__value"))
        & (F.lower("lemma") == F.col("__lemma"))
    )
    return spans.join(w, same, "left").drop("__language", "__value", "__pos", "__lemma")


# classes of documents


def bin_edges(low: float, high: float, n: int, integer: bool = False) -> list[tuple[float, float]]:
    """n ranges of equal width from low to high; of integers, ranges that touch and begin at whole numbers."""
    width = (high - low) / n
    if not integer:
        return [(low + k * width, high if k == n - 1 else low + (k + 1) * width) for k in range(n)]
    return [(float(int(low + k * width)), float(high if k == n - 1 else int(low + (k + 1) * width))) for k in range(n)]


def _number_text(x: Column) -> Column:
    """Up to two digits after the point, none for whole numbers."""
    cents = F.round(x * 100, 0).cast("bigint")
    rest = F.pmod(F.abs(cents), F.lit(100))
    units = ((F.abs(cents) - rest) / 100).cast("bigint").cast("string")
    digits = F.regexp_replace(F.lpad(rest.cast("string"), 2, "0"), "0+$", "")
    return F.concat(F.when(cents < 0, F.lit("-")).otherwise(F.lit("")), units, F.when(digits != "", F.concat(F.lit("."), digits)).otherwise(F.lit("")))


def document_values(catalog: Catalog, privileged: Sequence[str] = ("author", "date_value"), excluded: Sequence[str] = SKIPPED_ATTRIBUTES) -> DataFrame:
    """(document_id, name, value, number) of privileged fields and attributes of all documents."""
    d = catalog.document
    out = catalog.document_attribute.filter(~F.lower("name").isin(*excluded)).select("document_id", "name", "value", to_number(F.col("value")).alias("number"))
    for name in privileged:
        own = d.select(F.col("id").alias("document_id"), F.lit(name).alias("name"), F.col(name).cast("string").alias("value"), F.col(name).try_cast("double").alias("number"))
        out = out.unionByName(own.filter("value is not null"))
    return out


def document_pairs(catalog: Catalog, bins: Mapping[str, int] | None = None, integers: Sequence[str] = (), **kwargs) -> DataFrame:
    """(document_id, name, value): the classes that each document is in.

    bins: how many ranges of equal width the numbers of an attribute make; their least and largest numbers come from one
    aggregation that is joined back by name (a row each).  The last range includes its end.  A name that begins with ^ means
    ranges of whole numbers, and so does one of integers."""
    bins = DEFAULT_BINS if bins is None else bins
    whole = {*integers, *(k[1:] for k in bins if k.startswith("^"))}
    bins = {k.lstrip("^"): n for k, n in bins.items()}
    values = document_values(catalog, **kwargs)
    if not bins:
        return values.select("document_id", "name", "value").distinct()
    counts = F.create_map(*(x for k, n in bins.items() for x in (F.lit(k), F.lit(float(n)))))
    ranges = values.filter(F.col("name").isin(*bins) & F.col("number").isNotNull()).groupBy("name").agg(F.min("number").alias("__low"), F.max("number").alias("__high"))
    numbered = values.filter(F.col("name").isin(*bins) & F.col("number").isNotNull()).join(F.broadcast(ranges), "name")  # a row for each binned name
    n = F.try_element_at(counts, F.col("name"))
    width = (F.col("__high") - F.col("__low")) / n
    k = F.when(width > 0, F.least(F.floor((F.col("number") - F.col("__low")) / width), n - 1)).otherwise(F.lit(0))
    low, high = F.col("__low") + k * width, F.when(k == n - 1, F.col("__high")).otherwise(F.col("__low") + (k + 1) * width)
    if whole:
        is_whole = F.col("name").isin(*whole)
        low, high = F.when(is_whole, F.floor(low).cast("double")).otherwise(low), F.when(is_whole, F.floor(high).cast("double")).otherwise(high)
    binned = numbered.select("document_id", "name", F.concat(_number_text(low), F.lit(":"), _number_text(high)).alias("value"))
    plain = values.filter(~F.col("name").isin(*bins)).select("document_id", "name", "value")
    return plain.unionByName(binned).distinct()


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select("name", "value").distinct()


# counts


def count_words(tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word_id, lemma_id, doc_attr_name, doc_attr_value, count)."""
    per_document = tokens.groupBy("document_id", "language", "value", "pos", "lemma").agg(F.count(F.lit(1)).alias("n"))
    ids = per_document.select("document_id", word_id().alias("word_id"), lemma_id().alias("lemma_id"), "n")
    joined = ids.join(pairs.select("document_id", F.col("name").alias("doc_attr_name"), F.col("value").alias("doc_attr_value")), "document_id")
    return joined.groupBy("word_id", "lemma_id", "doc_attr_name", "doc_attr_value").agg(F.sum("n").alias("count"))


def document_classes(pairs: DataFrame) -> DataFrame:
    """(document_id, class, pairs): documents that are in the same classes have the same number."""
    own = pairs.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(F.col("name").alias("doc_attr_name"), F.col("value").alias("doc_attr_value")))).alias("pairs"))
    return own.select("document_id", F.xxhash64("pairs").alias("class"), "pairs")


#: So many different sets of classes are sent to all machines.
SENT_CLASSES = 20_000


def count_by_class(counted: DataFrame, classes: DataFrame) -> DataFrame:
    """As count_words, from (class, language, value, pos, lemma, n) and (class, pairs).

    What is shuffled is a row for a word of some documents of a class; the pairs of the class are looked up afterwards."""
    word = ("language", "value", "pos", "lemma")
    if classes.limit(SENT_CLASSES + 1).count() <= SENT_CLASSES:
        spread = counted.repartition("value", "language").join(F.broadcast(classes), "class")  # the counts by pairs need no further exchange
    else:
        spread = counted.join(classes, "class")
    spread = spread.select(*word, "n", F.inline("pairs"))
    out = spread.groupBy(*word, "doc_attr_name", "doc_attr_value").agg(F.sum("n").alias("count"))
    return out.select(word_id().alias("word_id"), lemma_id().alias("lemma_id"), "doc_attr_name", "doc_attr_value", "count")


def count_lemmata(word_counts: DataFrame) -> DataFrame:
    return word_counts.groupBy("lemma_id", "doc_attr_name", "doc_attr_value").agg(F.sum("count").alias("count"))


def token_distribution(counts: DataFrame, attribute: str, word: int | Column | None = None, lemma: int | Column | None = None) -> DataFrame:
    """(doc_attr_value, count) of one word or lemma, most frequent first."""
    which = F.col("word_id") == word if word is not None else F.col("lemma_id") == lemma
    found = counts.filter(which & (F.lower("doc_attr_name") == attribute.lower()) & (F.col("count") > 0))
    return found.groupBy("doc_attr_value").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "doc_attr_value")


# browsing


def browse(
    entries: DataFrame,
    pattern: str | None = None,
    min_length: int = 0,
    max_length: int = 0,
    min_count: int = 0,
    max_count: int = 0,
    pos: str | None = None,
    language: str | None = None,
    lemma_id: int | None = None,
    sort: str = "value",
    descending: bool = False,
    page: int | None = None,
    size: int = 20,
) -> DataFrame:
    """Words or lemmata that fit a filter, in order of value, reversed_value or count, by page if one is named.

    A pattern with % or _ is matched as LIKE does, any other exactly; a pattern whose only wildcard is a leading % is a test of
    the ending, which reversed values answer as a prefix that reaches the scan."""
    test = F.lit(True)
    if pattern:
        if pattern.startswith("%") and pattern.count("%") == 1 and "_" not in pattern:
            test = test & F.col("reversed_value").startswith(pattern[1:][::-1])
        elif "%" in pattern or "_" in pattern:
            test = test & F.col("value").like(pattern)
        else:
            test = test & (F.col("value") == pattern)
    for bound, column, up in ((min_length, F.length("value"), True), (max_length, F.length("value"), False), (min_count, F.col("count"), True), (max_count, F.col("count"), False)):
        if bound > 0:
            test = test & (column >= bound if up else column <= bound)
    for name, wanted in (("pos", pos), ("language", language), ("lemma_id", lemma_id)):
        if wanted is not None:
            test = test & (F.col(name) == wanted)
    if sort not in ("value", "reversed_value", "count"):
        raise ValueError(f"no order by {sort}")
    key = F.col(sort).desc() if descending else F.col(sort).asc()
    ordered = entries.filter(test).orderBy(key, "value", "id")
    return ordered if page is None else ordered.limit(page * size).offset((page - 1) * size)


def with_word_index(catalog: Catalog, bins: Mapping[str, int] | None = None, excluded_pos: Sequence[str] = (), excluded_attributes: Sequence[str] = ()) -> Catalog:
    """The collection with words, lemmata and their counts by classes of documents."""
    tokens = index_tokens(catalog, excluded_pos, excluded_attributes)
    word = build_words(tokens)
    counts = count_words(tokens, document_pairs(catalog, bins))
    return replace(catalog, word=word, lemma=build_lemmata(word), word_count=counts, lemma_count=count_lemmata(counts))


# statistics


def statistics(catalog: Catalog) -> DataFrame:
    """(name, value) rows: how many rows tables have (name_count), spans of each type (span.type), attributes of each name (@name; of
    a name that documents and spans have, those of spans), and the ratios of attributes to what has them (name_ratio)."""

    def size(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(name).alias("name"), "value")

    def grouped(df: DataFrame, column: str, prefix: str) -> DataFrame:
        return df.groupBy(F.concat(F.lit(prefix), F.col(column)).alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"))

    of_documents = grouped(catalog.document_attribute, "name", "@")
    sized = [size(catalog.corpus, "corpus_count"), size(catalog.document, "document_count"), size(catalog.document_attribute, "document_attribute_count"), size(catalog.profile, "profile_count")]
    if catalog.wide is not None:  # one scan tells all of spans, a few rows
        spark, names = catalog.wide.sparkSession, [c for c in catalog.wide.columns if c.startswith(ATTRIBUTE)]
        found = catalog.wide.groupBy("type").agg(F.count(F.lit(1)).alias("n"), *(F.count(c).alias(c) for c in names)).collect()
        each = {c: sum(r[c] for r in found) for c in names}
        of_tok = sum(r[c] for r in found if r["type"] == "tok" for c in names)
        ddl = "name string, value double"
        of_spans = spark.createDataFrame([("@" + c[len(ATTRIBUTE) :], float(n)) for c, n in each.items() if n], ddl)
        of_types = spark.createDataFrame([("span." + r["type"], float(r["n"])) for r in found], ddl)
        counts = (("span_count", sum(r["n"] for r in found)), ("span_attribute_count", sum(each.values())), ("span_tok_attribute_count", of_tok))
        sized.append(spark.createDataFrame([(n, float(x)) for n, x in counts], ddl))
    else:
        tok = catalog.span.filter("type = 'tok'").select(F.col("id").alias("span_id"))
        of_spans, of_types = grouped(catalog.span_attribute, "name", "@"), grouped(catalog.span, "type", "span.")
        sized += [size(catalog.span, "span_count"), size(catalog.span_attribute, "span_attribute_count"), size(catalog.span_attribute.join(tok, "span_id", "left_semi"), "span_tok_attribute_count")]
    of_documents = of_documents.join(of_spans.select("name"), "name", "left_anti")
    sized += [size(df, name) for df, name in ((catalog.word, "word_count"), (catalog.lemma, "lemma_count")) if df is not None]
    counted = reduce(DataFrame.unionByName, [*sized, of_types])

    def of(n: str) -> Column:
        return F.max(F.when(F.col("name") == n, F.col("value")))

    pairs = (("document_attribute_count", "document_count"), ("span_attribute_count", "span_count"), ("span_tok_attribute_count", "span.tok"))
    each = F.array(*(F.struct(F.lit(f"{a}_ratio").alias("name"), F.try_divide(of(a), of(b)).alias("value")) for a, b in pairs))
    ratios = counted.agg(each.alias("x")).select(F.inline("x")).filter("value is not null")
    return counted.unionByName(of_documents).unionByName(of_spans).unionByName(ratios)
