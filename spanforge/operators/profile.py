"""Profiles: a description of a collection's analysis (as JSON or a dict) and the pipeline that it makes.

    {"text_filters": ["tei", {"replace": [["ſ", "s", false, 1]]}], "tokenizer": "standard", "token_filters": ["normal"],
     "protected_tags": ["persName"], "tagging": {"stop_tags": ["head"], "most": 1000}, "attributes": ["len", "letters", "punctuation"],
     "mappings": ["date=TEI/teiHeader/date/@when [N]"], "structures": [{"type": "lg", "path": "lg", "value": "{@n}"}],
     "structure_filter": true, "structure_documents": {"genre": "poetry"},
     "sentences": {"stop_tags": ["head"]}, "date": {"attribute": "date", "kind": "year"}}

tokenizer: whitespace, standard, or xml (of the text between tags, with entities decoded).  protected_tags: elements in which tokens are
only trimmed and folded.  tagging: sentences are given to a tagger (an argument of `build`); without one s0 marks where they begin.
structure_filter: values of structures are normalised.  structure_documents: only documents with one of these attributes get structures.  A
structure that is a ghost gives its value to the tokens inside, as an attribute or, if that is called pos, as the part of speech.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.analysis import markup
from spanforge.analysis.tagged import tag_sentences
from spanforge.analysis.tokens import TOKEN_FILTERS, full_tokens
from spanforge.functions.text import sort_key, structure_value, to_number, year_value, ymd_value
from spanforge.model import NUMBER, TEXT, Catalog, span_id
from spanforge.operators.corpora import positions_of_ranges
from spanforge.runtime import ship

TEXT_FILTERS: dict[str, Callable[[Column], Column]] = {
    "tei": lambda c: markup.on_text(markup.tei_filter, c),
    "tags": lambda c: markup.on_text(markup.fill_tags, c),
    "entities": lambda c: markup.on_text(markup.resolve_entities, c),
    "apostrophes": markup.straight_apostrophes,
}
_RANGES = "array<struct<start:int,end:int>>"


def _text_filter(c: Column, spec: object) -> Column:
    if isinstance(spec, Mapping):
        return markup.replace_all(c, spec["replace"])
    if spec not in TEXT_FILTERS:
        raise ValueError(f"no text filter {spec}")
    return TEXT_FILTERS[spec](c)


def _ranges_of(c: Column, names: list[str]) -> Column:
    @F.pandas_udf(_RANGES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: [{"start": a, "end": z} for _, a, z in markup.tag_ranges(t, names)] if t else [])

    return run(c)


def date_value(value: Column, kind: str) -> Column:
    return {"number": to_number, "year": year_value, "ymd": ymd_value, "unix": lambda c: ymd_value(c, unix=True)}[kind](value)


def _sentence_ranges(docs: DataFrame, stop_tags: list[str], no_marker_tags: list[str]) -> DataFrame:
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, a, z) for i, t in zip(b["document_id"], b["content"]) if t for k, (a, z) in enumerate(markup.sentences(t, stop_tags, no_marker_tags))]
            yield pd.DataFrame(rows, columns=["document_id", "range_id", "start", "end"])

    return docs.mapInPandas(run, "document_id bigint, range_id int, start int, end int")


def build(docs: DataFrame, profile: Mapping | str, corpus: DataFrame | None = None, tagger: Callable[[list[str]], list[dict[str, str]]] | None = None) -> Catalog:
    """Documents (id, source, content[, author, title]) to a whole collection.  Ranges of structures become positions by an equi
    join on pages of characters; nothing is collected."""
    ship(docs.sparkSession)
    p = json.loads(profile) if isinstance(profile, str) else profile
    spark = docs.sparkSession
    filtered = F.col("content")
    for name in p.get("text_filters", ()):
        filtered = _text_filter(filtered, name)
    unknown = [f for f in p.get("token_filters", ()) if f not in TOKEN_FILTERS]
    if unknown:
        raise ValueError(f"no token filter {unknown[0]}")
    tokenizer, protected = p.get("tokenizer", "whitespace"), p.get("protected_tags")
    if tokenizer == "xml":
        filtered, tokenizer = markup.on_text(markup.resolve_entities, markup.on_text(markup.fill_tags, filtered)), "whitespace"
    ranges = [_ranges_of(F.col("content"), list(protected)).alias("protected")] if protected else []
    tokens = full_tokens(
        docs.select(F.col("id").alias("document_id"), filtered.alias("content"), *ranges), "document_id", "content", filters=tuple(p.get("token_filters", ("normal",))), tokenizer=tokenizer,
        protected="protected" if protected else None,
    )
    none = F.lit(None).cast("string")
    span = tokens.select(
        span_id(F.col("document_id"), F.col("position"), "tok").alias("id"), "document_id", F.lit("tok").alias("type"), F.col("position").alias("p1"), F.col("position").alias("p2"),
        "index", "length", none.alias("language"), none.alias("pos"), F.col("value").alias("lemma"), "value", F.col("raw").alias("text"),
    )
    attributes = span.select(F.col("id").alias("span_id"), "document_id", F.lit("len").alias("name"), F.length("value").cast("string").alias("value"), F.lit(NUMBER).alias("type"))
    if "len" not in p.get("attributes", ()):
        attributes = attributes.limit(0)
    if "punctuation" in p.get("attributes", ()):
        left, right = F.regexp_extract("text", r"^([^\p{L}\p{Nd}]*)", 1), F.regexp_extract("text", r"([^\p{L}\p{Nd}]*)$", 1)
        for name, c in (("lp", left), ("rp", right)):
            attributes = attributes.unionByName(span.select(F.col("id").alias("span_id"), "document_id", F.lit(name).alias("name"), c.alias("value"), F.lit(TEXT).alias("type")).filter("value <> ''"))
    if "letters" in p.get("attributes", ()):
        letters = F.length(F.regexp_replace("value", r"[^\p{L}]", "")).cast("string")
        attributes = attributes.unionByName(span.select(F.col("id").alias("span_id"), "document_id", F.lit("letters").alias("name"), letters.alias("value"), F.lit(NUMBER).alias("type")))
    content = docs.select(F.col("id").alias("document_id"), "content")
    mappings = [markup.AttributeMapping.parse(m) for m in p.get("mappings", ())]
    empty = Catalog.empty(spark)
    document_attribute = markup.document_attributes(content, mappings) if mappings else empty.document_attribute
    if "tagging" in p:
        how = p["tagging"]
        ranges_ = positions_of_ranges(span, _sentence_ranges(content, how.get("stop_tags", []), how.get("no_marker_tags", []))).filter("p1 is not null")
        of_range = ranges_.select("document_id", F.col("range_id").alias("sentence"), F.explode(F.sequence("p1", "p2")).alias("position"))
        in_order = tokens.select("document_id", "position", "raw").join(of_range, ["document_id", "position"])
        said = tag_sentences(in_order, tagger, how.get("most", 1000))
        said = span.select(F.col("id").alias("span_id"), "document_id", F.col("p1").alias("position")).join(said, ["document_id", "position"])
        fields = ("pos", "lemma")
        own = said.filter(F.col("name").isin(*fields)).groupBy(F.col("span_id").alias("id")).agg(*(F.max(F.when(F.col("name") == f, F.col("value"))).alias(f"__{f}") for f in fields))
        columns = span.columns
        span = span.join(own, "id", "left").withColumns({f: F.coalesce(f"__{f}", f) for f in fields}).select(*columns)
        attributes = attributes.unionByName(said.filter(~F.col("name").isin(*fields)).select("span_id", "document_id", "name", "value", F.lit(TEXT).alias("type")))
    made, ghosts = [], []
    if p.get("structures"):
        definitions = [markup.StructureDefinition(**d) for d in p["structures"]]
        parsed = content
        if p.get("structure_documents"):
            test = F.lit(False)
            for name, value in p["structure_documents"].items():
                test = test | ((F.lower("name") == name.lower()) & (F.lower("value") == value.lower()))
            parsed = content.join(document_attribute.filter(test).select("document_id"), "document_id", "left_semi")
        found = positions_of_ranges(span, markup.structures(parsed, definitions)).filter("p1 is not null")
        if p.get("structure_filter"):
            found = found.withColumn("value", F.when(F.col("ghost"), F.col("value")).otherwise(structure_value(F.col("value"))))
        made.append(found.filter("not ghost").select("document_id", "range_id", "type", "start", "end", "p1", "p2", "value"))
        ghosts.append(found.filter("ghost"))
    if "sentences" in p:
        s = p["sentences"]
        ranges = positions_of_ranges(span, _sentence_ranges(content, s.get("stop_tags", []), s.get("no_marker_tags", []))).filter("p1 is not null")
        made.append(ranges.select("document_id", "range_id", F.lit("snt").alias("type"), "start", "end", "p1", "p2", (F.col("end") - F.col("start")).cast("string").alias("value")))
    for g in ghosts:
        inside = g.filter("attribute = 'pos'").select("document_id", F.col("value").alias("__pos"), F.explode(F.sequence("p1", "p2")).alias("p1"))
        own, columns = inside.groupBy("document_id", "p1").agg(F.min("__pos").alias("__pos")), span.columns
        span = span.join(own, ["document_id", "p1"], "left").withColumn("pos", F.coalesce("__pos", "pos")).select(*columns)
    ghosts = [g.filter("attribute <> 'pos'") for g in ghosts]
    tokens_only = span
    for k, m in enumerate(made):
        span = span.unionByName(
            m.select(
                span_id(F.col("document_id"), F.col("range_id"), 1 + k).alias("id"), "document_id", "type", "p1", "p2", F.col("start").alias("index"),
                (F.col("end") - F.col("start")).cast("int").alias("length"), none.alias("language"), none.alias("pos"), none.alias("lemma"), "value", none.alias("text"),
            )
        )
    for g in ghosts:  # attributes of the tokens inside, never of structures: an equi join on (document, position)
        inside = g.select("document_id", "attribute", "value", F.explode(F.sequence("p1", "p2")).alias("p1"))
        hit = tokens_only.select("id", "document_id", "p1").join(inside, ["document_id", "p1"])
        attributes = attributes.unionByName(hit.select(F.col("id").alias("span_id"), "document_id", F.col("attribute").alias("name"), "value", F.lit(TEXT).alias("type")))
    author, title = (F.col(c) if c in docs.columns else none for c in ("author", "title"))
    base = docs.select("id", author.alias("author"), title.alias("title"), "source", "content")
    if p.get("date"):
        dates = document_attribute.filter(F.col("name") == p["date"]["attribute"]).groupBy(F.col("document_id").alias("id")).agg(F.min("value").alias("__date"))
        base = base.join(dates, "id", "left").withColumn("date_value", date_value(F.col("__date"), p["date"].get("kind", "number")))
    else:
        base = base.withColumn("date_value", F.lit(None).cast("double"))
    document = base.select(
        "id", "author", "title", "source", F.lit(p.get("id", "default")).alias("profile_id"), none.alias("user_id"), "date_value",
        sort_key(F.col("author"), F.col("title"), F.col("date_value")).alias("sort_key"), F.lit(None).cast("timestamp").alias("last_modified"), "content",
    )
    row = spark.createDataFrame([(p.get("id", "default"), json.dumps(p, sort_keys=True), "analysis", None)], "id string, content string, type string, user_id string")
    return Catalog(document, document_attribute, empty.corpus, corpus if corpus is not None else empty.document_corpus, span, attributes, row)
