"""Lexicon lookup, tags of parts of speech with a small query language, and word checks.

A lexicon is a DataFrame (id, value, text, lemma, pos).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.text import damerau_similarity, plain_text
from spanforge.model import Catalog
from spanforge.operators.search import kwic
from spanforge.runtime import ship

LEXICON_DDL = "id bigint, value string, text string, lemma string, pos string"
MODES = ("exact", "prefix", "suffix", "substring", "fuzzy")


def lookup(lexicon: DataFrame, words: DataFrame, with_pos: bool = False) -> DataFrame:
    """Entries of each word (value[, pos]) of a table, by an equi join."""
    keys = ["value", "pos"] if with_pos else ["value"]
    return words.select(*keys).distinct().join(lexicon, keys)


def find(
    lexicon: DataFrame, text: str | None = None, mode: str = "exact", threshold: float = 0.8, lemma: str | None = None, pos: str | None = None, page: int | None = None, size: int = 20
) -> DataFrame:
    """Entries whose value fits; prefix, suffix and substring ignore case.  A fuzzy search takes all entries of at least this
    similarity; what it drops before they are compared can't have it."""
    if mode not in MODES:
        raise ValueError(f"no mode {mode}")
    out = lexicon
    if lemma is not None:
        out = out.filter(F.col("lemma") == lemma)
    if pos is not None:
        out = out.filter(tag_subset(F.col("pos"), pos))
    if text is not None:
        low, value = text.lower(), F.lower("value")
        if mode == "exact":
            out = out.filter(F.col("value") == text)
        elif mode == "prefix":
            out = out.filter(value.startswith(low))
        elif mode == "suffix":
            out = out.filter(value.endswith(low))
        elif mode == "substring":
            out = out.filter(value.contains(low))
        else:
            out = may_be_similar(out, text, threshold).filter(damerau_similarity(F.col("value"), text) >= threshold)
    out = out.orderBy("value", "id")
    return out if page is None else out.limit(page * size).offset((page - 1) * size)


def may_be_similar(lexicon: DataFrame, text: str, threshold: float) -> DataFrame:
    """Without entries that are too far from the text: the distance is at most what the threshold leaves of the longer length, and
    at least the difference of the lengths in bytes; of values in ASCII it is at least half of the edits without transpositions."""
    most = (1 - threshold) * F.greatest(F.length("value"), F.lit(len(text))) + 1e-9
    out = lexicon.filter(F.abs(F.octet_length("value") - len(text.encode())) <= most)
    if threshold <= 0 or not text.isascii():
        return out
    edits = 2 * int((1 - threshold) * len(text) / threshold + 1e-9)  # a similar value has at most len(text) / threshold characters
    return out.filter((F.octet_length("value") > F.length("value")) | (F.levenshtein("value", F.lit(text), edits) >= 0))


# tags: POS:Feature=Value|Feature=Value


def parse_tag(tag: str) -> tuple[str, dict[str, str]]:
    pos, _, rest = tag.partition(":")
    return pos, dict(x.split("=", 1) for x in rest.split("|") if "=" in x)


def build_tag(pos: str, features: dict[str, str]) -> str:
    """Features in order of their names."""
    return pos + (":" + "|".join(f"{k}={v}" for k, v in sorted(features.items())) if features else "")


def tag_features(tag: Column) -> Column:
    return F.str_to_map(F.regexp_extract(tag, r"^[^:]*:?(.*)$", 1), F.lit("\\|"), F.lit("="))


def tag_pos(tag: Column) -> Column:
    return F.regexp_extract(tag, r"^([^:]*)", 1)


def tag_subset(tag: Column, wanted: str) -> Column:
    """Whether the tag has the part of speech and all features of a wanted one."""
    pos, features = parse_tag(wanted)
    test = tag_pos(tag) == pos if pos else F.lit(True)
    for k, v in features.items():
        test = test & F.coalesce(F.try_element_at(tag_features(tag), F.lit(k)) == v, F.lit(False))
    return F.coalesce(test, F.lit(False))


_TAG_QUERY = re.compile(r"\s*(?:(?P<open>\()|(?P<close>\))|(?P<op>AND|OR)\b|(?P<name>\w+)\s*(?P<cmp>!=|=)\s*(?P<value>[\w\-]+)|(?P<bare>\w+))")


def tag_query(tag: Column, query: str) -> Column:
    """A condition on a tag such as NOUN AND (gender=m OR number!=sing); AND and OR go from left to right, a bare word is a part of speech."""
    tokens, at = [], 0
    while query[at:].strip():
        m = _TAG_QUERY.match(query, at)
        if not m:
            raise ValueError(f"can't read {query[at:]!r}")
        tokens.append(m)
        at = m.end()
    k = 0

    def primary() -> Column:
        nonlocal k
        if k >= len(tokens):
            raise ValueError("the query ends too early")
        m = tokens[k]
        k += 1
        if m["open"]:
            inner = expression()
            if k >= len(tokens) or not tokens[k]["close"]:
                raise ValueError(") is missing")
            k += 1
            return inner
        if m["bare"]:
            return F.coalesce(tag_pos(tag) == m["bare"], F.lit(False))
        if not m["name"]:
            raise ValueError(f"{m[0].strip()!r} stands in a wrong place")
        same = F.coalesce(F.try_element_at(tag_features(tag), F.lit(m["name"])) == m["value"], F.lit(False))
        return same if m["cmp"] == "=" else ~same

    def expression() -> Column:
        nonlocal k
        left = primary()
        while k < len(tokens) and tokens[k]["op"]:
            op = tokens[k]["op"]
            k += 1
            right = primary()
            left = left & right if op == "AND" else left | right
        return left

    out = expression()
    if k < len(tokens):
        raise ValueError(f"unexpected {tokens[k][0].strip()!r}")
    return out


# variants of Italian forms

_ENCLITICS = "gliene gliela glielo glieli gliele mela melo meli mele tela telo teli tele cela celo vela velo sela selo seli sele mene tene cene vene sene celi cele veli vele gliene mi ti ci vi si lo la li le ne gli".split()
_INVERTED = dict(zip("àèìòùáéíóú", "áéíóúàèìòù"))
_ACCENTS = {"a'": "à", "e'": "è", "i'": "ì", "o'": "ò", "u'": "ù"}


def italian_variants(word: str) -> list[tuple[str, str]]:
    """(form, rule) of what an unknown form may stand for, each form once and in order of the rules."""
    w = word.lower()
    out: list[tuple[str, str]] = []

    def add(form: str, rule: str) -> None:
        if form and form != w and all(form != f for f, _ in out):
            out.append((form, rule))

    if m := re.fullmatch(r"(.{2,})issim([oaie])", w):  # superlatives
        stem = m[1]
        for form in (stem + m[2], stem + "e", stem[:-1] + ("co" if stem.endswith("ch") else "go") if stem.endswith(("ch", "gh")) else "", stem + "o"):
            add(form, "superlative")
    if m := re.fullmatch(r"(da|di|fa|sta|va)(?:mmi|tti|llo|lle|lla|lli|cci|nne)", w):  # short imperatives double what follows
        add(m[1] + "'", "enclitic")
        add(m[1], "enclitic")
    for clitic in _ENCLITICS:  # verbs with pronouns at the end
        if w.endswith(clitic) and len(w) - len(clitic) >= 3:
            stem = w[: -len(clitic)]
            add(stem, "enclitic")
            if stem.endswith("r"):  # infinitives, those in -rre before those in -re
                add(stem + "re", "enclitic")
                add(stem + "e", "enclitic")
            if clitic == "si" and re.search(r"[ei]si$", w):  # present participles
                add(stem[:-1] + "e", "enclitic")
            if stem.endswith(("a", "e", "i")) and not stem.endswith("r"):
                add(stem + "re", "enclitic")
            if len(stem) > 3 and stem[-1] == stem[-2]:
                add(stem[:-1], "enclitic")
    if re.fullmatch(r".{2,}[lnmr]", w):  # a vowel has fallen off
        for v in "eoai":
            add(w + v, "truncation")
        for v in "eio":  # of a double consonant one has fallen off too
            add(w + w[-1] + v, "truncation")
    if w.endswith("'"):  # or has been elided
        for v in "oaei":
            add(w[:-1] + v, "elision")
        for mark, letter in _ACCENTS.items():
            if w.endswith(mark):
                add(w[: -len(mark)] + letter, "accent")
    if w.startswith("'"):
        add(w[1:], "artifact")
    if w.endswith("'"):
        add(w[:-1], "artifact")
    trimmed = re.sub(r"^[^\w]+|[^\w]+$", "", w)
    add(trimmed, "artifact")
    add(re.sub(r"(\w)-(\w)", r"\1\2", w), "artifact")
    add(w.replace("j", "i"), "iota")
    if w.endswith("ii"):
        add(w[:-1], "iota")
    if re.match(r"is[bcdfglmnpqrtvz]", w):
        add(w[1:], "prothesis")
    marked = [k for k, c in enumerate(w) if c in _INVERTED]
    for mask in range(1, 1 << min(len(marked), 4)):  # any of the first accents may be the other one
        letters = list(w)
        for bit, k in enumerate(marked[:4]):
            if mask >> bit & 1:
                letters[k] = _INVERTED[w[k]]
        add("".join(letters), "accent")
    add(plain_text(w), "accent")
    return out


def word_variants(words: DataFrame) -> DataFrame:
    """(value, variant, rule, rank) of the distinct words of a table, in Arrow batches."""
    ship(words.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(v, f, r, k) for v in b["value"] for k, (f, r) in enumerate(italian_variants(v))]
            yield pd.DataFrame(rows, columns=["value", "variant", "rule", "rank"])

    return words.select("value").filter("value is not null").distinct().mapInPandas(run, "value string, variant string, rule string, rank int")


def check_words(
    words: DataFrame, lexicon: DataFrame, white: Sequence[str] = (), skipped_pos: Sequence[str] = (), variants: bool = True
) -> DataFrame:
    """(value, pos, code, type, message, action, data): each word against a lexicon.

    ok if it is known (or white) and an entry's tag fits its own; pos_mismatch if none fits; var_found if a variant is known, with the
    first as data; else not_found."""
    words = words.select("value", "pos").distinct()
    if skipped_pos:
        words = words.filter(F.col("pos").isNull() | ~tag_pos(F.col("pos")).isin(*skipped_pos))
    entries = lexicon.filter("value is not null").select(F.col("value").alias("__value"), F.col("pos").alias("__pos"))
    fits = F.col("pos").isNull() | F.col("__pos").isNull() | (tag_pos(F.col("pos")) == tag_pos(F.col("__pos")))
    known = (
        words.join(entries, F.lower("value") == F.lower("__value"), "left")
        .groupBy("value", "pos")
        .agg(F.max(F.col("__value").isNotNull()).alias("known"), F.max(F.coalesce(fits & F.col("__value").isNotNull(), F.lit(False))).alias("fits"), F.min("__pos").alias("other"))
    )
    is_white = F.lower("value").isin(*(w.lower() for w in white)) if white else F.lit(False)
    out = known.withColumn("__ok", is_white)
    if variants:
        unknown = known.filter(~F.col("known") & ~is_white)
        found = word_variants(unknown).join(entries.select("__value").distinct(), F.col("variant") == F.lower("__value")).groupBy("value").agg(F.min(F.struct("rank", "variant", "rule")).alias("__variant"))
        out = out.join(found, "value", "left")
    else:
        out = out.withColumn("__variant", F.lit(None).cast("struct<rank:int,variant:string,rule:string>"))
    code = (
        F.when(F.col("__ok"), "ok").when(F.col("known") & F.col("fits"), "ok").when(F.col("known"), "pos_mismatch").when(F.col("__variant").isNotNull(), "var_found").otherwise("not_found")
    )
    kinds = {"ok": ("info", "known", "none"), "pos_mismatch": ("warning", "known with another part of speech", "check_pos"), "var_found": ("warning", "a variant is known", "replace"), "not_found": ("error", "unknown", "check")}

    def of(k: int) -> Column:
        return reduce(lambda c, x: c.when(F.col("code") == x, kinds[x][k]), list(kinds)[1:], F.when(F.col("code") == "ok", kinds["ok"][k]))

    data = F.when(F.col("code") == "pos_mismatch", F.col("other")).when(F.col("code") == "var_found", F.col("__variant.variant"))
    return out.withColumn("code", code).select("value", "pos", "code", of(0).alias("type"), of(1).alias("message"), of(2).alias("action"), data.alias("data"))


def check_spans(
    catalog: Catalog,
    lexicon: DataFrame,
    white: Sequence[str] = (),
    excluded_pos: Sequence[str] = (),
    excluded_attributes: Mapping[str, str | None] | None = None,
    alphabetic: bool = False,
    context: int = 5,
) -> DataFrame:
    """What `check_words` finds wrong with the tokens of no language of their own, a row for each token: its document and context too.

    excluded_attributes: tokens that have such an attribute (of this value, if one is named) aren't checked.  context: tokens on either
    side; with 0 the context is the token's text."""
    spans = catalog.span.filter("type = 'tok'").filter(F.coalesce("language", F.lit("")) == "")
    if excluded_pos:
        spans = spans.filter(~F.coalesce("pos", F.lit("")).isin(*excluded_pos))
    if alphabetic:
        spans = spans.filter(F.col("value").rlike(r"\p{L}"))
    for name, value in (excluded_attributes or {}).items():
        test = F.lower("name") == name.lower()
        bad = catalog.span_attribute.filter(test if value is None else test & (F.col("value") == value)).select(F.col("span_id").alias("id"))
        spans = spans.join(bad, "id", "left_anti")
    wrong = check_words(spans.select("value", "pos"), lexicon, white).filter("type <> 'info'")
    on = (F.col("s.value") == F.col("w.value")) & F.col("s.pos").eqNullSafe(F.col("w.pos"))
    found = spans.alias("s").join(wrong.alias("w"), on).select("s.*", "w.code", F.col("w.type").alias("severity"), "w.message", "w.action", "w.data")
    if context:
        found = kwic(found, catalog, context)
        words = F.concat_ws(" ", F.filter("left", lambda x: x != ""), F.array(F.concat(F.lit("["), "text", F.lit("]"))), F.filter("right", lambda x: x != ""))
    else:
        words = F.col("text")
    return found.select("id", "document_id", "p1", "value", "pos", "lemma", "code", F.col("severity").alias("type"), "message", "action", "data", words.alias("context"))


_MORPH = {"NOUN": "NOUN", "ADJ": "ADJ", "VER": "VERB", "ADV": "ADV", "ART": "DET", "PRE": "ADP", "PRO": "PRON", "CON": "CCONJ", "INT": "INTJ", "DET": "DET", "AUX": "AUX", "MOD": "AUX"}
_FEATURES = {"m": "gender=masc", "f": "gender=fem", "s": "number=sing", "p": "number=plur", "pos": "degree=pos", "comp": "degree=comp", "sup": "degree=sup", "ind": "mood=ind", "sub": "mood=sub", "cond": "mood=cond", "impr": "mood=imp", "inf": "verbform=inf", "ger": "verbform=ger", "part": "verbform=part", "pres": "tense=pres", "past": "tense=past", "impf": "tense=imp", "fut": "tense=fut", "1": "person=1", "2": "person=2", "3": "person=3"}


def convert_morph_list(rows: DataFrame) -> DataFrame:
    """A lexicon from (form, lemma, features) rows whose features look like NOUN-M:s or VER:ind+pres+3+s."""
    head = F.upper(F.regexp_extract("features", r"^([A-Za-z]+)", 1))
    pos = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in _MORPH.items() for x in kv)), head), head)
    bits = F.split(F.lower(F.regexp_extract("features", r"^[A-Za-z]+[\-:]?(.*)$", 1)), r"[\-:+]")
    names = F.create_map(*(F.lit(x) for kv in _FEATURES.items() for x in kv))
    known = F.array_sort(F.filter(F.transform(bits, lambda b: F.try_element_at(names, b)), lambda x: x.isNotNull()))
    tag = F.when(F.size(known) > 0, F.concat(pos, F.lit(":"), F.array_join(known, "|"))).otherwise(pos)
    return rows.select(F.xxhash64("form", "lemma", "features").alias("id"), F.lower("form").alias("value"), F.col("form").alias("text"), "lemma", tag.alias("pos"))
