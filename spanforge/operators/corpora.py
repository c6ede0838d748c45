"""Documents, corpora and profiles: filters, paging and edits.  An edit returns the new table; nothing is changed in place."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.model import DOCUMENT_PRIVILEGED, NUMBER, TEXT, Catalog
from spanforge.runtime import ship


@dataclass(frozen=True)
class DocumentFilter:
    """Tests that all hold; of attributes (name, part of the value) one is enough."""

    corpus_id: str | None = None
    corpus_prefix: str | None = None
    author: str | None = None
    title: str | None = None
    source: str | None = None
    profile_id: str | None = None
    profile_prefix: str | None = None
    user_id: str | None = None
    min_date: float | None = None
    max_date: float | None = None
    min_modified: str | None = None
    max_modified: str | None = None
    attributes: tuple[tuple[str, str], ...] = ()

    @property
    def empty(self) -> bool:
        return self == DocumentFilter()


def _contains(column: str, text: str) -> Column:
    return F.lower(column).contains(text.lower())


def paged(df: DataFrame, page: int | None, size: int) -> DataFrame:
    """A page of an ordered table; size 0 means all."""
    return df if page is None or size == 0 else df.limit(page * size).offset((page - 1) * size)


def filter_documents(catalog: Catalog, f: DocumentFilter) -> DataFrame:
    test = F.lit(True)
    for column, text in (("author", f.author), ("title", f.title), ("source", f.source)):
        if text is not None:
            test = test & _contains(column, text)
    for column, exact in (("profile_id", f.profile_id), ("user_id", f.user_id)):
        if exact is not None:
            test = test & (F.col(column) == exact)
    if f.profile_prefix is not None:
        test = test & F.col("profile_id").startswith(f.profile_prefix)
    for column, low, high in (("date_value", f.min_date, f.max_date), ("last_modified", f.min_modified, f.max_modified)):
        if low is not None:
            test = test & (F.col(column) >= low)
        if high is not None:
            test = test & (F.col(column) <= high)
    out = catalog.document.filter(test)
    if f.corpus_id is not None or f.corpus_prefix is not None:
        of = F.lit(True)
        if f.corpus_id is not None:
            of = of & (F.lower("corpus_id") == f.corpus_id.lower())
        if f.corpus_prefix is not None:
            of = of & F.lower("corpus_id").startswith(f.corpus_prefix.lower())
        out = out.join(catalog.document_corpus.filter(of).select(F.col("document_id").alias("id")), "id", "left_semi")
    if f.attributes:
        some = F.lit(False)
        for name, part in f.attributes:
            some = some | ((F.lower("name") == name.lower()) & _contains("value", part))
        out = out.join(catalog.document_attribute.filter(some).select(F.col("document_id").alias("id")), "id", "left_semi")
    return out


def order_documents(docs: DataFrame, by: str = "default", descending: bool = False) -> DataFrame:
    keys = {"default": ("sort_key",), "author": ("author", "title", "sort_key"), "title": ("title", "author", "sort_key"), "date": ("date_value", "author", "title")}[by]
    return docs.orderBy(*(F.col(k).desc() if descending else F.col(k).asc() for k in keys), "id")


def get_documents(catalog: Catalog, f: DocumentFilter, by: str = "default", descending: bool = False, page: int | None = None, size: int = 20) -> DataFrame:
    return paged(order_documents(filter_documents(catalog, f), by, descending), page, size)


def get_document(catalog: Catalog, document_id: int | None = None, source: str | None = None) -> DataFrame:
    if document_id is not None:
        return catalog.document.filter(F.col("id") == document_id)
    return catalog.document.filter(F.col("source") == source).orderBy("id").limit(1)


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows replace those of the table that have the same keys; of rows with the same keys the last in `order` counts."""
    if order:
        w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
        rows = rows.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")
    else:
        rows = rows.dropDuplicates(list(keys))
    return table.join(rows.select(*keys), list(keys), "left_anti").select(*table.columns).unionByName(rows)


def set_content(catalog: Catalog, contents: DataFrame) -> DataFrame:
    """The documents with the contents of (id, content) rows."""
    new = contents.select("id", F.col("content").alias("__new"), F.lit(True).alias("__set"))
    columns = catalog.document.columns
    return catalog.document.join(new, "id", "left").withColumn("content", F.when(F.col("__set"), F.col("__new")).otherwise(F.col("content"))).select(*columns)


def delete_documents(catalog: Catalog, ids: DataFrame) -> Catalog:
    """The collection without the documents of these ids, their attributes, spans and places in corpora."""
    gone = ids.select(F.col("id").alias("__gone")).distinct()

    def without(df: DataFrame, key: str = "document_id") -> DataFrame:
        return df.join(gone, df[key] == F.col("__gone"), "left_anti")

    c = catalog
    return Catalog(without(c.document, "id"), without(c.document_attribute), c.corpus, without(c.document_corpus), without(c.span), without(c.span_attribute), c.profile)


def add_attribute(catalog: Catalog, rows: DataFrame, unique: bool = False) -> DataFrame:
    """The documents' attributes with more (document_id, name, value, type) rows; unique: they replace those of the same name."""
    old = catalog.document_attribute
    if unique:
        return upsert(old, rows, ("document_id", "name"))
    return old.unionByName(rows).distinct()


def attribute_names(catalog: Catalog, part: str = "", page: int | None = None, size: int = 20) -> DataFrame:
    found = catalog.document_attribute.filter(_contains("name", part)) if part else catalog.document_attribute
    return paged(found.select("name").distinct().orderBy("name"), page, size)


def attribute_info(catalog: Catalog, privileged: bool = True) -> DataFrame:
    """(name, type) of the attributes, with those of the document itself if privileged."""
    own = catalog.document_attribute.select("name", "type").distinct()
    if not privileged:
        return own
    spark = own.sparkSession
    fixed = [(n, NUMBER if n == "date_value" else TEXT) for n in DOCUMENT_PRIVILEGED]
    return own.unionByName(spark.createDataFrame(fixed, "name string, type int")).distinct()


# corpora


def get_corpora(
    catalog: Catalog, part: str | None = None, prefix: str | None = None, title: str | None = None, user_id: str | None = None, with_ids: bool = False, page: int | None = None, size: int = 20
) -> DataFrame:
    """Corpora with n_documents, or with document_ids as sorted arrays."""
    test = F.lit(True)
    if part is not None:
        test = test & _contains("id", part)
    if prefix is not None:
        test = test & F.lower("id").startswith(prefix.lower())
    if title is not None:
        test = test & _contains("title", title)
    if user_id is not None:
        test = test & (F.col("user_id") == user_id)
    what = F.array_sort(F.collect_set("document_id")).alias("document_ids") if with_ids else F.countDistinct("document_id").alias("n_documents")
    members = catalog.document_corpus.groupBy(F.col("corpus_id").alias("id")).agg(what)
    out = catalog.corpus.filter(test).join(members, "id", "left")
    if not with_ids:
        out = out.fillna(0, ["n_documents"])
    return paged(out.orderBy("title", "id"), page, size)


def _corpus_row(catalog: Catalog, corpus_id: str, title: str, description: str, user_id: str | None) -> DataFrame:
    spark = catalog.corpus.sparkSession
    return spark.createDataFrame([(corpus_id, title, description, user_id)], "id string, title string, description string, user_id string")


def add_corpus(catalog: Catalog, corpus_id: str, title: str = "", description: str = "", user_id: str | None = None, source: str | None = None) -> Catalog:
    """With a new (or changed) corpus, into which the documents of the corpus `source` go."""
    c = catalog
    members = c.document_corpus
    if source is not None:
        cloned = members.filter(F.col("corpus_id") == source).withColumn("corpus_id", F.lit(corpus_id))
        members = members.unionByName(cloned).distinct()
    corpora = upsert(c.corpus, _corpus_row(c, corpus_id, title or corpus_id, description, user_id), ("id",))
    return Catalog(c.document, c.document_attribute, corpora, members, c.span, c.span_attribute, c.profile)


def delete_corpus(catalog: Catalog, corpus_id: str) -> Catalog:
    c = catalog
    return Catalog(c.document, c.document_attribute, c.corpus.filter(F.col("id") != corpus_id), c.document_corpus.filter(F.col("corpus_id") != corpus_id), c.span, c.span_attribute, c.profile)


def add_documents(catalog: Catalog, corpus_id: str, ids: DataFrame, user_id: str | None = None) -> Catalog:
    """Puts documents into a corpus, which is made if it isn't there; documents that it has stay once."""
    c = catalog
    row = _corpus_row(c, corpus_id, corpus_id, "", user_id).join(c.corpus.select("id"), "id", "left_anti")
    new = ids.select(F.col("id").alias("document_id"), F.lit(corpus_id).alias("corpus_id"))
    members = c.document_corpus.unionByName(new).distinct()
    return Catalog(c.document, c.document_attribute, c.corpus.unionByName(row), members, c.span, c.span_attribute, c.profile)


def change_by_filter(catalog: Catalog, corpus_id: str, f: DocumentFilter, add: bool = True) -> DataFrame:
    """Members of all corpora after the documents of a filter went into a corpus or out of it; an empty filter changes nothing."""
    members = catalog.document_corpus
    if f.empty:
        return members
    found = filter_documents(catalog, f).select(F.col("id").alias("document_id"))
    own, others = members.filter(F.col("corpus_id") == corpus_id), members.filter(F.col("corpus_id") != corpus_id)
    if add:
        new = found.join(own.select("document_id"), "document_id", "left_anti").withColumn("corpus_id", F.lit(corpus_id))
        return members.unionByName(new)
    return others.unionByName(own.join(found, "document_id", "left_anti").select(*members.columns))


def in_corpus(catalog: Catalog, document_id: int, corpus_id: str, prefix: bool = False) -> bool:
    of = F.col("corpus_id").startswith(corpus_id) if prefix else F.col("corpus_id") == corpus_id
    return not catalog.document_corpus.filter(of & (F.col("document_id") == document_id)).isEmpty()


# profiles


def get_profiles(catalog: Catalog, part: str | None = None, prefix: str | None = None, kind: str | None = None, user_id: str | None = None, page: int | None = None, size: int = 20) -> DataFrame:
    test = F.lit(True)
    if part is not None:
        test = test & _contains("id", part)
    if prefix is not None:
        test = test & F.col("id").startswith(prefix)
    if kind is not None:
        test = test & (F.col("type") == kind)
    if user_id is not None:
        test = test & (F.col("user_id") == user_id)
    return paged(catalog.profile.filter(test).orderBy("id"), page, size)


def add_profile(catalog: Catalog, profile: Mapping[str, str]) -> DataFrame:
    spark = catalog.profile.sparkSession
    row = spark.createDataFrame([tuple(profile.get(k) for k in ("id", "content", "type", "user_id"))], "id string, content string, type string, user_id string")
    return upsert(catalog.profile, row, ("id",))


# spans


def get_spans(catalog: Catalog, kind: str | None = None, document_ids: Sequence[int] = (), low: int | None = None, high: int | None = None, attributes: Mapping[str, str | None] | None = None) -> DataFrame:
    """Spans by type, document, range of positions and attributes (all must be there), in order of document and position."""
    test = F.lit(True)
    if kind is not None:
        test = test & (F.col("type") == kind)
    if document_ids:
        test = test & F.col("document_id").isin(*document_ids)
    if low is not None:
        test = test & (F.col("p1") >= low)
    if high is not None:
        test = test & (F.col("p2") <= high)
    out = catalog.span.filter(test)
    for name, value in (attributes or {}).items():
        of = F.lower("name") == name.lower()
        own = catalog.span_attribute.filter(of if value is None else of & (F.col("value") == value))
        out = out.join(own.select(F.col("span_id").alias("id")), "id", "left_semi")
    return out.orderBy("document_id", "p1", "id")


def spans_at(catalog: Catalog, document_id: int, position: int, kind: str | None = None) -> DataFrame:
    out = catalog.span.filter((F.col("document_id") == document_id) & (F.col("p1") == position))
    return out if kind is None else out.filter(F.col("type") == kind)


def positions_of_ranges(tokens: DataFrame, ranges: DataFrame) -> DataFrame:
    """Of ranges (document_id, range_id, start, end) of characters the positions p1 and p2 of the tokens that begin in them.

    Ranges without tokens have nulls.  Tokens meet the ranges of their document by an equi join on the document and on pages of
    characters that both are cut into, so a long document doesn't join each with each; tokens of a page that follow each other
    are one row of it."""
    t = tokens.filter("type = 'tok' and document_id is not null and index is not null and p1 is not null and p2 is not null").select("document_id", "index", "p1", "p2")
    ship(tokens.sparkSession)
    return ranges_on_pages(t.mapInArrow(_runs, "document_id bigint, page bigint, low int, high int, p1 int, p2 int, indexes array<int>, p1s array<int>, p2s array<int>"), ranges)


def ranges_on_pages(runs: DataFrame, ranges: DataFrame) -> DataFrame:
    """As `positions_of_ranges`, of rows that have tokens of a page of PAGE characters (see `_runs`)."""
    cut = ranges.withColumn("page", F.explode(F.sequence(F.floor(F.col("start") / PAGE), F.floor(F.greatest("start", F.col("end") - 1) / PAGE)))).select("document_id", "range_id", "start", "end", "page")
    before, upto = F.size(F.filter("indexes", lambda x: x < F.col("start"))), F.size(F.filter("indexes", lambda x: x < F.col("end")))
    each = F.filter(F.arrays_zip("indexes", "p1s", "p2s"), lambda x: (x["indexes"] >= F.col("start")) & (x["indexes"] < F.col("end")))
    whole, plain = (F.col("low") >= F.col("start")) & (F.col("high") < F.col("end")), F.col("p1s").isNull()
    first = F.when(whole, F.col("p1")).when(plain, F.when(upto > before, F.col("p1") + before)).otherwise(F.array_min(F.transform(each, lambda x: x["p1s"])))
    last = F.when(whole, F.col("p2")).when(plain, F.when(upto > before, F.col("p1") + upto - 1)).otherwise(F.array_max(F.transform(each, lambda x: x["p2s"])))
    found = runs.join(cut, ["document_id", "page"]).filter("low < end and high >= start")
    by = found.select("document_id", "range_id", first.alias("p1"), last.alias("p2")).groupBy("document_id", "range_id").agg(F.min("p1").alias("p1"), F.max("p2").alias("p2"))
    return ranges.join(by, ["document_id", "range_id"], "left")


#: Characters of a page.
PAGE = 1024


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows for tokens of a page of a document that follow each other: the least and the greatest index and position, and the indexes in
    order; the positions too, unless they are numbers that follow each other."""
    for batch in batches:
        if not batch.num_rows:
            continue
        document, index, p1, p2 = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
        page = index // PAGE
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(document) != 0) | (np.diff(page) != 0)]))
        sizes = np.diff(np.append(starts, len(index)))
        run = np.repeat(np.arange(len(starts)), sizes)
        if (np.diff(index) < 0)[np.diff(run) == 0].any():
            order = np.lexsort((index, run))
            index, p1, p2 = index[order], p1[order], p2[order]
        low, high, first, last = (f.reduceat(x, starts) for f, x in ((np.minimum, index), (np.maximum, index), (np.minimum, p1), (np.maximum, p2)))
        expected = p1[starts][run] + np.arange(len(index)) - starts[run]
        plain = np.logical_and.reduceat((p1 == expected) & (p2 == expected), starts)

        def lists(x: np.ndarray, there: np.ndarray) -> pa.Array:
            offsets = np.concatenate([[0], np.cumsum(np.where(there, sizes, 0))]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[there[run]].astype(np.int32)), mask=pa.array(~there))

        small = [pa.array(x.astype(np.int32)) for x in (low, high, first, last)]
        every = np.ones(len(starts), bool)
        yield pa.RecordBatch.from_arrays(
            [pa.array(document[starts]), pa.array(page[starts]), *small, lists(index, every), lists(p1, ~plain), lists(p2, ~plain)],
            ["document_id", "page", "low", "high", "p1", "p2", "indexes", "p1s", "p2s"],
        )


def add_span_attribute(catalog: Catalog, document_id: int, start: int, end: int, name: str, value: str, kind: int = TEXT, span_type: str = "tok") -> Catalog:
    """An attribute for all spans of a type within [start, end]; a privileged name sets the column instead."""
    c = catalog
    hit = (F.col("document_id") == document_id) & (F.col("p1") >= start) & (F.col("p2") <= end) & (F.col("type") == span_type)
    if name in ("language", "pos", "lemma"):
        span = c.span.withColumn(name, F.when(hit, F.lit(value)).otherwise(F.col(name)))
        return Catalog(c.document, c.document_attribute, c.corpus, c.document_corpus, span, c.span_attribute, c.profile)
    new = c.span.filter(hit).select(F.col("id").alias("span_id"), "document_id", F.lit(name).alias("name"), F.lit(value).alias("value"), F.lit(kind).alias("type"))
    return Catalog(c.document, c.document_attribute, c.corpus, c.document_corpus, c.span, c.span_attribute.unionByName(new), c.profile)


def delete_span_attributes(catalog: Catalog, document_id: int, start: int, end: int, name: str) -> DataFrame:
    hit = catalog.span.filter((F.col("document_id") == document_id) & (F.col("p1") >= start) & (F.col("p2") <= end)).select(F.col("id").alias("span_id"))
    named = catalog.span_attribute.filter(F.col("name") == name).join(hit, "span_id", "left_semi")
    return catalog.span_attribute.join(named.select("span_id", "name"), ["span_id", "name"], "left_anti").select(*catalog.span_attribute.columns)


def delete_spans(catalog: Catalog, document_id: int, kind: str | None = None, others: bool = False) -> DataFrame:
    """Spans without those of a document: all, those of a type, or (others) those of all other types."""
    gone = F.col("document_id") == document_id
    if kind is not None:
        gone = gone & ((F.col("type") != kind) if others else (F.col("type") == kind))
    return catalog.span.filter(~gone)
