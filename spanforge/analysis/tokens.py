"""Tokenizers and token filters as Columns, and the two ways from documents to tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.analysis import scan
from spanforge.functions.text import SENTENCE_END, keep_alnum_apos, normalise_token, normalised_pieces

#: A currency sign alone, or a run that ends after an apostrophe which isn't its first character.
STANDARD = r"\p{Sc}|[^\s\p{Sc}][^\s\p{Sc}']*'?"


def split_whitespace(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def split_standard(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(STANDARD), F.lit(0))


TOKENIZERS: dict[str, Callable[[Column], Column]] = {"whitespace": split_whitespace, "standard": split_standard}
TOKEN_FILTERS: dict[str, Callable[[Column], Column]] = {
    "normal": normalise_token,
    "alnum-apos": keep_alnum_apos,
    "lo-alnum-apos": lambda c: keep_alnum_apos(c, lower=True),
    "none": lambda c: c,
}


def token_stream(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *carried: str, tokenizer: str = "whitespace", filters: tuple[str, ...] = ("normal",)
) -> DataFrame:
    """Rows (id, carried columns, position from 1, raw, value): a narrow plan, since positions come from the array itself.

    Tokens of which the filters leave nothing have no position.  A null text has no tokens."""

    def value(x: Column) -> Column:
        for f in filters:
            x = TOKEN_FILTERS[f](x)
        return x

    if (tokenizer, filters) == ("whitespace", ("normal",)):
        split = F.arrays_zip(F.split(text_col, r"\s+").alias("raw"), normalised_pieces(F.col(text_col)).alias("value"))
        kept = F.filter(split, lambda t: t["value"] != "")
        return docs.select(id_col, *carried, F.posexplode(kept).alias("pos", "t")).select(
            id_col, *carried, (F.col("pos") + 1).alias("position"), F.col("t.raw").alias("raw"), F.col("t.value").alias("value")
        )
    pieces = F.transform(TOKENIZERS[tokenizer](F.col(text_col)), lambda x: F.struct(x.alias("raw"), value(x).alias("value")))
    kept = F.filter(pieces, lambda t: t["value"] != "")
    exploded = docs.select(id_col, *carried, F.posexplode(kept).alias("pos", "t"))
    return exploded.select(id_col, *carried, (F.col("pos") + 1).alias("position"), F.col("t.raw").alias("raw"), F.col("t.value").alias("value"))


def full_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *carried: str, filters: tuple[str, ...] = ("normal",), tokenizer: str = "whitespace", protected: str | None = None
) -> DataFrame:
    """Rows (id, carried columns, position, index, length, line, sentence, raw, value) of all tokens that the filters leave something of.

    Pieces between white space go through one pass over the texts, without a shuffle.  With other filters or tokenizers positions,
    character offsets (code points from 0), lines and sentences are running sums over one window per document.  protected: a column of
    ranges (start, end) of the text; of the tokens that begin there only the edges are trimmed and the case is folded."""
    if tokenizer not in TOKENIZERS:
        raise ValueError(f"no tokenizer {tokenizer}")
    if (tokenizer, tuple(filters), protected) == ("whitespace", ("normal",), None):
        return scan.tokens(docs, id_col, text_col, carried, ("position", "index", "length", "line", "sentence", "raw", "value"))
    kept = [*carried, *([protected] if protected else [])]
    if tokenizer == "whitespace":
        lines = docs.select(id_col, *kept, F.posexplode(F.split(text_col, "\n")).alias("line", "body"))
        pieces = lines.select(id_col, *kept, (F.col("line") + 1).alias("line"), F.posexplode(F.split("body", r"\s")).alias("k", "raw"))
        width = F.length("raw") + 1  # with the blank behind it
    else:  # pieces and white space make up the whole text
        pieces = docs.select(id_col, *kept, F.posexplode(F.regexp_extract_all(text_col, F.lit(r"\s|" + STANDARD), F.lit(0))).alias("k", "raw")).withColumn("line", F.lit(0))
        width = F.length("raw")
    value = F.col("raw")
    for f in filters:
        value = TOKEN_FILTERS[f](value)
    if tokenizer != "whitespace":
        value = F.when(F.col("raw").rlike(r"^\s$"), F.lit("")).otherwise(value)
    pieces = pieces.withColumn("value", value)
    w = Window.partitionBy(id_col).orderBy("line", "k")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("index", (F.sum(width).over(upto) - width).cast("int"))
    if protected:
        inside = F.exists(protected, lambda r: (F.col("index") >= r["start"]) & (F.col("index") < r["end"]))
        edges = F.lower(F.regexp_replace("raw", r"^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$", ""))
        placed = placed.withColumn("value", F.when(inside, edges).otherwise(F.col("value")))
    if tokenizer != "whitespace":
        placed = placed.withColumn("line", F.coalesce(F.sum((F.col("raw") == "\n").cast("int")).over(before), F.lit(0)).cast("int") + 1)
    return (
        placed.withColumns(
            {
                "position": F.sum((F.col("value") != "").cast("int")).over(upto).cast("int"),
                "length": F.length("raw"),
                "sentence": (F.coalesce(F.sum(F.col("raw").rlike(SENTENCE_END).cast("int")).over(before), F.lit(0)) + 1).cast("int"),
            }
        )
        .filter("value <> ''")
        .select(id_col, *carried, "position", "index", "length", "line", "sentence", "raw", "value")
    )


def length_attribute(tokens: DataFrame, letters_only: bool = False) -> DataFrame:
    """Adds len, a number: characters of the value, or its letters alone."""
    c = F.regexp_replace("value", r"[^\p{L}]", "") if letters_only else F.col("value")
    return tokens.withColumn("len", F.length(c))


def punctuation_attributes(tokens: DataFrame, white: str | None = None, black: str | None = None) -> DataFrame:
    """Adds lp and rp, the punctuation at either edge of raw (null where there is none).

    white: only these characters count; black: these don't."""

    def allowed(c: Column) -> Column:
        if white:
            c = F.regexp_replace(c, "[^" + "".join("\\" + x for x in white) + "]", "")
        if black:
            c = F.regexp_replace(c, "[" + "".join("\\" + x for x in black) + "]", "")
        return F.nullif(c, F.lit(""))

    left, right = F.regexp_extract("raw", r"^([^\p{L}\p{Nd}]*)", 1), F.regexp_extract("raw", r"([^\p{L}\p{Nd}]*)$", 1)
    return tokens.withColumns({"lp": allowed(left), "rp": allowed(right)})


def supply_from_cache(tokens: DataFrame, cache: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Attribute rows (document_id, position, name, value) of the tokens for which a cache has one of these names."""
    wanted = cache.filter(F.col("name").isin(*names)).select("document_id", "position", "name", F.col("value").alias("attribute"))
    found = tokens.join(wanted, ["document_id", "position"])
    return found.select("document_id", "position", "name", F.col("attribute").alias("value"))
