"""What a tagger of parts of speech finds, brought onto the tokens of a collection.

A tagger's tokens are rows of TAGGED_DDL.  A multiword token (as a preposition with its article) has the words it is made of as
children; they have no place in the text of their own."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.model import NUMBER, TEXT
from spanforge.runtime import ship

_FEATS = "map<string,string>"
TAGGED_DDL = (
    f"document_id bigint, index int, length int, form string, lemma string, upos string, xpos string, feats {_FEATS}, head int, deprel string, misc string, "
    f"children array<struct<upos:string,xpos:string,feats:{_FEATS}>>"
)
PROPERTIES = ("lemma", "upos", "xpos", "feats", "head", "deprel", "misc")
#: Characters of a page, by which ranges meet in equi joins.
PAGE = 4096


def _feats(text: str) -> dict[str, str]:
    return dict(x.split("=", 1) for x in text.split("|") if "=" in x)


def parse_conllu(text: str, start: int = 0) -> list[dict]:
    """Tokens of a CoNLL-U analysis whose MISC has TokenRange=a:b, moved by where the analysed piece of text starts.  Rows without a
    range are children of the multiword token before them."""
    out: list[dict] = []
    for line in text.splitlines():
        cells = line.split("\t")
        if line.startswith("#") or len(cells) != 10 or "." in cells[0]:
            continue
        value = [None if c == "_" else c for c in cells]
        feats, misc = _feats(value[5] or ""), dict(x.split("=", 1) for x in (value[9] or "").split("|") if "=" in x)
        if "TokenRange" not in misc:
            if out and out[-1]["children"] is not None:
                out[-1]["children"].append({"upos": value[3], "xpos": value[4], "feats": feats})
            continue
        a, z = map(int, misc["TokenRange"].split(":"))
        out.append(
            {"index": start + a, "length": z - a, "form": value[1], "lemma": value[2], "upos": value[3], "xpos": value[4], "feats": feats, "head": int(value[6]) if value[6] else None}
            | {"deprel": value[7], "misc": value[9], "children": [] if "-" in cells[0] else None}
        )
    return out


def child_rule(children: Sequence[Mapping], rules: Sequence[Mapping]) -> dict | None:
    """The target of the first rule that the children fit, with the features that it takes from them.

    A rule: {"min": n, "max": n, "tokens": [{"upos", "xpos", "feats", "optional"}], "target": {"lemma", "upos", "xpos", "feats"}}.  A feature of
    the target may name a child (from 1) that has it; the name * takes all of a child's."""

    def fits(child: Mapping, wanted: Mapping) -> bool:
        if any(wanted.get(k) and child.get(k) != wanted[k] for k in ("upos", "xpos")):
            return False
        return all((child.get("feats") or {}).get(k) == v for k, v in (wanted.get("feats") or {}).items())

    for rule in rules:
        if len(children) < rule.get("min", 0) or rule.get("max", 0) and len(children) > rule["max"]:
            continue
        k = 0
        for wanted in rule.get("tokens", ()):
            if k < len(children) and fits(children[k], wanted):
                k += 1
            elif not wanted.get("optional"):
                break
        else:
            target = rule["target"]
            feats: dict[str, str] = {}
            for name, value in (target.get("feats") or {}).items():
                of = children[int(value) - 1].get("feats") or {} if value.isdigit() and 0 < int(value) <= len(children) else None
                if name == "*":
                    feats |= of or {}
                elif of is None:
                    feats[name] = value
                elif name in of:
                    feats[name] = of[name]
            return {"lemma": target.get("lemma"), "upos": target.get("upos"), "xpos": target.get("xpos"), "feats": feats}
    return None


def _targets(children: Column, rules: Sequence[Mapping]) -> Column:
    ship()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if (found := child_rule(json.loads(x), rules)) is None else json.dumps(found), na_action="ignore")

    return F.from_json(run(F.to_json(children)), f"lemma string, upos string, xpos string, feats {_FEATS}")


def _paged(df: DataFrame, index: str = "index", length: str = "length") -> DataFrame:
    last = F.col(index) + F.greatest(F.col(length), F.lit(1)) - 1
    return df.withColumn("__page", F.explode(F.sequence(F.floor(F.col(index) / PAGE), F.floor(last / PAGE))))


def apply_tagger(
    spans: DataFrame,
    tagged: DataFrame,
    properties: Sequence[str] = PROPERTIES,
    preserved: Sequence[str] = (),
    multiwords: Sequence[Mapping] = (),
    overrides: DataFrame | None = None,
    prefix: str = "",
    feat_prefix: str = "",
    extended_pos: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The spans with lemma and part of speech of the tagger, and rows (span_id, document_id, name, value, type) of what else it says.

    A token gets the first of the tagger's tokens, no punctuation, that overlaps it.  overrides: ranges of the markup (document_id, index,
    length, upos, xpos, feats) that win over the tagger where they overlap its token.  Otherwise tokens whose part of speech is among
    `preserved` and isn't the tagger's stay as they are, and a multiword token gets what the first fitting rule says (`child_rule`)."""
    tokens = spans.filter("type = 'tok'").select(F.col("id").alias("span_id"), "document_id", "index", "length", F.col("pos").alias("old_pos"), F.col("value").alias("old_value"))
    columns = ("lemma", "upos", "xpos", "feats", "head", "deprel", "misc", "children")
    right = tagged.filter("upos is null or upos <> 'PUNCT'").select("document_id", F.struct(F.col("index").alias("i"), F.col("length").alias("l")).alias("at"), F.struct(*columns).alias("t"), "index", "length")
    hit = _paged(tokens).join(_paged(right).select("document_id", "__page", "at", "t"), ["document_id", "__page"]).filter("index < at.i + at.l and at.i < index + length")
    first = Window.partitionBy("span_id").orderBy("at.i", "at.l", "__page")
    matched = hit.withColumn("__k", F.row_number().over(first)).filter("__k = 1").select("span_id", "document_id", "old_pos", "old_value", "at", "t")
    if overrides is None:
        found = matched.withColumn("o", F.lit(None).cast(f"struct<upos:string,xpos:string,feats:{_FEATS}>"))
    else:
        marked = overrides.withColumn("__o", F.monotonically_increasing_id())
        right = _paged(marked).select("document_id", "__page", F.col("index").alias("oi"), F.col("length").alias("ol"), "__o", F.struct("upos", "xpos", "feats").alias("o"))
        pages = _paged(matched.select("span_id", "document_id", F.col("at.i").alias("index"), F.col("at.l").alias("length")))
        over = pages.join(right, ["document_id", "__page"]).filter("index < oi + ol and oi < index + length")
        over = over.withColumn("__k", F.row_number().over(Window.partitionBy("span_id").orderBy("__o", "__page"))).filter("__k = 1").select("span_id", "o")
        found = matched.join(over, "span_id", "left")
    is_over, is_multi = F.col("o").isNotNull(), F.col("t.children").isNotNull()
    kept = F.col("old_pos").isin(*preserved) & (F.col("old_pos") != F.coalesce("t.upos", F.lit(""))) if preserved else F.lit(False)
    found = found.filter(is_over | ~F.coalesce(kept, F.lit(False))).withColumn("m", F.when(is_multi & ~is_over, _targets(F.col("t.children"), multiwords)))
    found = found.filter(is_over | ~is_multi | F.col("m").isNotNull())
    multi = F.col("m").isNotNull()
    plain_feats = F.when(F.size(F.coalesce("o.feats", F.create_map().cast(_FEATS))) > 0, F.col("o.feats")).otherwise(F.col("t.feats"))
    said = found.select(
        "span_id", "document_id",
        F.when(multi, F.coalesce(F.nullif("m.lemma", F.lit("")), "old_value")).otherwise(F.col("t.lemma")).alias("lemma"),
        F.when(multi, F.col("m.upos")).otherwise(F.coalesce("o.upos", "t.upos")).alias("upos"),
        F.when(multi, F.col("m.xpos")).otherwise(F.coalesce("o.xpos", "t.xpos")).alias("xpos"),
        F.when(multi, F.col("m.feats")).otherwise(plain_feats).alias("feats"),
        *(F.when(~multi, F.col(f"t.{c}")).alias(c) for c in ("head", "deprel", "misc")),
    )
    new_pos = F.coalesce(F.nullif("__upos", F.lit("")), "pos") if "upos" in properties else F.col("pos")
    if extended_pos and "xpos" in properties:
        new_pos = F.when((F.coalesce(new_pos, F.lit("")) != "") & F.col("__xpos").isNotNull(), F.concat(new_pos, F.lit("."), "__xpos")).otherwise(new_pos)
    new_lemma = F.coalesce(F.nullif("__lemma", F.lit("")), "lemma") if "lemma" in properties else F.col("lemma")
    joined = spans.join(said.select(F.col("span_id").alias("id"), F.col("lemma").alias("__lemma"), F.col("upos").alias("__upos"), F.col("xpos").alias("__xpos")), "id", "left")
    out = joined.withColumns({"pos": new_pos, "lemma": new_lemma}).select(*spans.columns)
    name = F.concat(F.lit(feat_prefix + prefix), F.col("k")) if feat_prefix else F.concat(F.lit(prefix), F.lower("k"))
    parts = [
        said.select("span_id", "document_id", F.lit(prefix + c).alias("name"), F.col(c).cast("string").alias("value"), F.lit(NUMBER if c == "head" else TEXT).alias("type")).filter("value is not null")
        for c in ("xpos", "head", "deprel", "misc")
        if c in properties
    ]
    if "feats" in properties:
        parts.append(said.select("span_id", "document_id", F.explode("feats").alias("k", "v")).select("span_id", "document_id", name.alias("name"), F.lower("v").alias("value"), F.lit(TEXT).alias("type")))
    attributes = parts[0] if parts else said.select("span_id", "document_id", F.lit("").alias("name"), F.lit("").alias("value"), F.lit(TEXT).alias("type")).filter("false")
    for p in parts[1:]:
        attributes = attributes.unionByName(p)
    return out, attributes


def tag_sentences(tokens: DataFrame, tagger=None, most: int = 1000) -> DataFrame:
    """Attribute rows (document_id, position, name, value) of tokens (document_id, position, sentence, raw): those that a function from a list of
    tokens to a list of attributes finds, a sentence (of at most so many tokens) at a time, and s0 where one begins."""
    ship(tokens.sparkSession)
    n = F.row_number().over(Window.partitionBy("document_id", "sentence").orderBy("position"))
    cut = tokens.withColumn("__part", F.floor((n - 1) / most).cast("int"))
    ddl = "document_id bigint, position int, name string, value string"
    if tagger is None:
        first = cut.groupBy("document_id", "sentence", "__part").agg(F.min("position").alias("position"))
        return first.select("document_id", "position", F.lit("s0").alias("name"), F.lit("1").alias("value"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("position")
        rows = [(d, p, "s0", "1") for d, p in zip(g["document_id"][:1], g["position"][:1])]
        rows += [(d, p, k, v) for d, p, found in zip(g["document_id"], g["position"], tagger(g["raw"].tolist())) for k, v in found.items()]
        return pd.DataFrame(rows, columns=["document_id", "position", "name", "value"])

    return cut.select("document_id", "sentence", "__part", "position", "raw").groupBy("document_id", "sentence", "__part").applyInPandas(run, ddl)
