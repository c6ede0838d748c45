"""Marked-up text: filters that keep all offsets, a tolerant scanner of elements, structures, sentences and chunks.

Filters blank what they remove, so every character that stays keeps its place.  The pure functions work on one text; `on_text`
makes a column function of one in Arrow batches.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.runtime import ship

_TAG = re.compile(r"<(?P<end>/)?(?P<name>[A-Za-z_][\w:.\-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(?P<self>/)?>|<!--.*?-->|<\?.*?\?>|<![^>]*>", re.S)
_ATTR = re.compile(r"([\w:.\-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9A-Fa-f]+|\w+);")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


#: So many characters leave a worker at a time.
CHARACTERS = 1 << 22


def in_parts(f: Callable[[str], str], batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """What f makes of the texts; a batch leaves in parts, of which one is held."""
    for batch in batches:
        done: list[str | None] = []
        size = 0
        for x in batch:
            text = x.as_py()
            done.append(None if text is None else f(text))
            size += len(done[-1] or "")
            if size >= CHARACTERS:
                yield pa.array(done, pa.string())
                done, size = [], 0
        if done or not len(batch):
            yield pa.array(done, pa.string())


def on_text(f: Callable[[str], str], c: Column) -> Column:
    ship()

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from in_parts(f, batches)

    return run(c)


def _blank(text: str) -> str:
    return re.sub(r"\S", " ", text)


def fill_tags(text: str, names: Sequence[str] | None = None) -> str:
    """Blanks all tags, or, with names, these elements with all they hold."""
    if names is None:
        return _TAG.sub(lambda m: _blank(m[0]), text)
    wanted, out = {n.lower() for n in names}, list(text)
    for e in elements(text):
        if e.name.lower() in wanted:
            out[e.start : e.end] = _blank(text[e.start : e.end])
    return "".join(out)


def tei_filter(text: str, keep_tags: bool = False) -> str:
    """Blanks the header, and all tags unless they are kept."""
    text = fill_tags(text, ["teiHeader"])
    return text if keep_tags else fill_tags(text)


def resolve_entities(text: str, padded: bool = True) -> str:
    """Characters for entities; padded: blanks behind them keep the length."""

    def decode(m: re.Match) -> str:
        c = html.unescape(m[0])
        return c + " " * (len(m[0]) - len(c)) if padded else c

    return _ENTITY.sub(decode, text)


def replace_all(c: Column, rules: Sequence[tuple[str, str, bool, int]]) -> Column:
    """Ordered replacements (find, replacement, is a regular expression, times), as a chain of built-in functions."""
    for find, replacement, is_regex, times in rules:
        for _ in range(max(1, times)):
            c = F.regexp_replace(c, find, replacement) if is_regex else F.replace(c, F.lit(find), F.lit(replacement))
    return c


def straight_apostrophes(c: Column) -> Column:
    """U+2019 between letters becomes a plain apostrophe."""
    return F.regexp_replace(c, r"(?<=\p{L})’(?=\p{L})", "'")


@dataclass
class Element:
    name: str
    start: int
    end: int
    inner_start: int
    inner_end: int
    attributes: dict[str, str]
    parent: int
    path: str
    depth: int = 0
    number: int = 1


def elements(text: str) -> list[Element]:
    """All elements in order of their beginnings; unclosed ones end with their parent, stray end tags are ignored."""
    out: list[Element] = []
    open_: list[int] = []
    seen: list[dict[str, int]] = [{}]
    for m in _TAG.finditer(text):
        name = m["name"]
        if not name:
            continue
        if m["end"]:
            at = next((k for k in range(len(open_) - 1, -1, -1) if out[open_[k]].name == name), None)
            if at is None:
                continue
            for k in open_[at:]:
                out[k].inner_end, out[k].end = m.start(), m.start()
            out[open_[at]].end = m.end()
            del open_[at:], seen[at + 1 :]
            continue
        attributes = {a[0]: html.unescape(a[1] or a[2] or a[3]) for a in _ATTR.findall(m["attrs"] or "")}
        number = seen[-1][name] = seen[-1].get(name, 0) + 1
        parent = open_[-1] if open_ else -1
        path = (out[parent].path if open_ else "") + f"/{name}[{number}]"
        out.append(Element(name, m.start(), m.end(), m.end(), m.end(), attributes, parent, path, len(open_), number))
        if not m["self"] and name.lower() not in _VOID:
            open_.append(len(out) - 1)
            seen.append({})
    for k in open_:
        out[k].inner_end = out[k].end = len(text)
    return out


def inner_text(text: str, e: Element) -> str:
    return html.unescape(re.sub(r"\s+", " ", _TAG.sub(" ", text[e.inner_start : e.inner_end]))).strip()


def tag_ranges(text: str, names: Sequence[str]) -> list[tuple[str, int, int]]:
    """(name, start, end) of the contents of these elements."""
    wanted = {n.lower() for n in names}
    return [(e.name, e.inner_start, e.inner_end) for e in elements(text) if e.name.lower() in wanted]


@dataclass(frozen=True)
class StructureDefinition:
    """Elements (a chain of names such as 'div/lg', with [@a] or [@a='v'] behind a name) that make structures of a type.

    value: a template with {@attribute}, {text} or {name}.  A ghost makes no structures: its value is an attribute (or, if named so,
    the part of speech) of the tokens inside."""

    type: str
    path: str
    value: str = ""
    ghost: bool = False
    attribute: str = ""


_STEP = re.compile(r"^(?P<name>[\w:.\-*]+)(?:\[@(?P<attr>[\w:.\-]+)(?:=['\"](?P<value>[^'\"]*)['\"])?\])?$")


def matches(path: str, e: Element, every: list[Element]) -> bool:
    steps = [s for s in path.strip("/").split("/") if s]
    node: Element | None = e
    for s in reversed(steps):
        m = _STEP.match(s)
        if not m:
            raise ValueError(f"can't read the step {s!r}")
        if node is None or (m["name"] != "*" and node.name.split(":")[-1].lower() != m["name"].split(":")[-1].lower()):
            return False
        if m["attr"] and (m["attr"] not in node.attributes or (m["value"] is not None and node.attributes[m["attr"]] != m["value"])):
            return False
        node = every[node.parent] if node.parent >= 0 else None
    return True


def fill_template(template: str, text: str, e: Element) -> str:
    def part(m: re.Match) -> str:
        return e.attributes.get(m[1][1:], "") if m[1].startswith("@") else inner_text(text, e) if m[1] == "text" else e.name

    return re.sub(r"\{(@?[\w:.\-]+)\}", part, template)


def find_structures(text: str, definitions: Sequence[StructureDefinition]) -> list[tuple[str, int, int, str, bool, str]]:
    """(type, start, end, value, ghost, attribute) of all structures, with the characters they span."""
    every = elements(text)
    return [(d.type, e.inner_start, e.inner_end, fill_template(d.value, text, e), d.ghost, d.attribute) for e in every for d in definitions if matches(d.path, e, every)]


def structures(docs: DataFrame, definitions: Sequence[StructureDefinition], id_col: str = "document_id", text_col: str = "content") -> DataFrame:
    """(document_id, range_id, type, start, end, value, ghost, attribute) of all documents, in Arrow batches.

    corpora.positions_of_ranges gives their positions."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, *s) for i, t in zip(b["document_id"], b["content"]) if t for k, s in enumerate(find_structures(t, definitions))]
            yield pd.DataFrame(rows, columns=["document_id", "range_id", "type", "start", "end", "value", "ghost", "attribute"])

    narrow = docs.select(F.col(id_col).alias("document_id"), F.col(text_col).alias("content"))
    return narrow.mapInPandas(run, "document_id bigint, range_id int, type string, start int, end int, value string, ghost boolean, attribute string")


# sentences

_END = ".?!;"


def sentences(text: str, stop_tags: Sequence[str] = (), no_marker_tags: Sequence[str] = ()) -> list[tuple[int, int]]:
    """Ranges of sentences in marked-up text: up to a mark of their end, or to the edge of a stop tag; marks inside tags of the
    other kind (as abbreviations) don't end any.  Ranges without letters or digits are left out."""
    plain = list(resolve_entities(fill_tags(text)))  # the semicolon of an entity ends no sentence
    stops = {t.lower() for t in stop_tags}
    cuts: set[int] = set()
    for e in elements(text):
        if e.name.lower() in stops:
            cuts |= {e.start, e.end}
        if e.name.lower() in {t.lower() for t in no_marker_tags}:
            for i in range(e.inner_start, e.inner_end):
                if plain[i] in _END + ";":
                    plain[i] = ","
    flat = "".join(plain)
    for m in re.finditer(rf"[{re.escape(_END)};]+[\"'”’»)\]]*", flat):
        cuts.add(m.end())
    out, start = [], 0
    for end in [*sorted(cuts), len(flat)]:
        part = flat[start:end]
        if any(c.isalnum() for c in part):
            out.append((start + len(part) - len(part.lstrip()), start + len(part.rstrip())))
        start = end
    return out


def chunks(text: str, most: int = 5000) -> list[tuple[int, int]]:
    """Ranges of at most so many characters that end behind sentences where they can, else behind blanks, else anywhere."""
    out, start = [], 0
    while len(text) - start > most:
        window = text[start : start + most]
        ends = [m.end() for m in re.finditer(r"[.?!;;]+\s+", window)] or [m.end() for m in re.finditer(r"\s+", window)]
        cut = ends[-1] if ends else most
        out.append((start, start + cut))
        start += cut
    if start < len(text):
        out.append((start, len(text)))
    return out


# tokens of marked-up text


@dataclass
class XmlToken:
    position: int
    index: int
    length: int
    text: str
    value: str
    path: str
    attributes: dict[str, str] = field(default_factory=dict)


def xml_tokens(text: str, inner: Callable[[str], Iterator[tuple[int, str]]], filtered: Callable[[str], str]) -> list[XmlToken]:
    """Tokens of the text nodes, with positions that run on and offsets in the whole."""
    out: list[XmlToken] = []
    at, path = 0, ""
    stack: list[str] = []

    def emit(start: int, end: int) -> None:
        for i, raw in inner(text[start:end]):
            value = filtered(html.unescape(raw))
            if value:
                out.append(XmlToken(len(out) + 1, start + i, len(raw), raw, value, path))

    for m in _TAG.finditer(text):
        emit(at, m.start())
        at = m.end()
        if m["name"]:
            if m["end"]:
                if m["name"] in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(m["name"]) :]
            elif not m["self"] and m["name"].lower() not in _VOID:
                stack.append(m["name"])
            path = "/".join(stack)
    emit(at, len(text))
    return out


def whitespace_tokens(text: str) -> Iterator[tuple[int, str]]:
    return ((m.start(), m[0]) for m in re.finditer(r"\S+", text))


Tagger = Callable[[list[str]], list[dict[str, str]]]


def tag_sentences(tokens: list[XmlToken], tagger: Tagger, most: int = 1000) -> None:
    """Gives tokens the attributes that a tagger finds, a sentence (of at most so many tokens) at a time; s0 marks where one begins."""
    queue: list[XmlToken] = []

    def flush() -> None:
        if queue:
            queue[0].attributes["s0"] = "1"
            for t, found in zip(queue, tagger([x.text for x in queue])):
                t.attributes.update(found)
            queue.clear()

    for t in tokens:
        queue.append(t)
        if len(queue) >= most or re.search(r"[.?!;;][\"'”’»)\]]*$", html.unescape(t.text)):
            flush()
    flush()


def tagged_value(raw: str, index: int, ranges: Sequence[tuple[int, int]], filtered: Callable[[str], str]) -> str:
    """The value of a token: inside these ranges only its edges are trimmed and its case folded."""
    if any(a <= index < b for a, b in ranges):
        return re.sub(r"^\W+|\W+$", "", raw).lower()
    return filtered(raw)


def overlapping_tags(tokens: DataFrame, tagged: DataFrame, preserved: Sequence[str] = ()) -> DataFrame:
    """Attribute rows (span_id, name, value) for tokens from a tagger's tokens (document_id, index, length, name, value) that overlap them.

    Tokens and the tagger's tokens meet by an equi join on (document, page of characters).  Of several that overlap (as parts of a
    word that a tagger splits) the first counts.  Names in preserved are left as they are."""
    page = 4096

    def pages(df: DataFrame) -> DataFrame:
        last = F.col("index") + F.greatest(F.col("length"), F.lit(1)) - 1
        return df.withColumn("__page", F.explode(F.sequence(F.floor(F.col("index") / page), F.floor(last / page))))

    t = pages(tokens.filter("type = 'tok'").select(F.col("id").alias("span_id"), "document_id", "index", "length"))
    g = pages(tagged).select("document_id", "__page", F.col("index").alias("i"), F.col("length").alias("l"), "name", "value")
    if preserved:
        g = g.filter(~F.col("name").isin(*preserved))
    hit = t.join(g, ["document_id", "__page"]).filter("index < i + l and i < index + length")
    return hit.groupBy("span_id", "name").agg(F.min(F.struct("i", "value")).alias("x")).select("span_id", "name", F.col("x.value").alias("value"))


# metadata


@dataclass(frozen=True)
class AttributeMapping:
    """name[+]=path [N|T] [regular expression]; the path ends in a name or in @attribute; + joins all values, else the first counts."""

    name: str
    path: str
    number: bool = False
    pattern: str | None = None
    many: bool = False

    @classmethod
    def parse(cls, line: str) -> AttributeMapping:
        m = re.fullmatch(r"\s*([\w.\-]+)(\+)?\s*=\s*(\S+)(?:\s+\[([NT])\])?(?:\s+(.+?))?\s*", line)
        if not m:
            raise ValueError(f"can't read the mapping {line!r}")
        return cls(m[1], m[3], m[4] == "N", m[5], bool(m[2]))


def map_attributes(text: str, mappings: Sequence[AttributeMapping]) -> list[tuple[str, str, int]]:
    """(name, value, type) rows of one text."""
    every = elements(text)
    out = []
    for m in mappings:
        path, _, attribute = m.path.partition("/@")
        values = []
        for e in every:
            if matches(path, e, every) and (not attribute or attribute in e.attributes):
                v = e.attributes[attribute] if attribute else inner_text(text, e)
                if m.pattern:
                    found = re.search(m.pattern, v)
                    v = (found[1] if found and found.groups() else found[0]) if found else ""
                if v:
                    values.append(v)
        out += [(m.name, v, int(m.number)) for v in (values if m.many else values[:1])]
    return out


def document_attributes(docs: DataFrame, mappings: Sequence[AttributeMapping], id_col: str = "document_id", text_col: str = "content") -> DataFrame:
    """(document_id, name, value, type) of all documents, in Arrow batches."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *a) for i, t in zip(b["document_id"], b["content"]) if t for a in map_attributes(t, mappings)]
            yield pd.DataFrame(rows, columns=["document_id", "name", "value", "type"])

    narrow = docs.select(F.col(id_col).alias("document_id"), F.col(text_col).alias("content"))
    return narrow.mapInPandas(run, "document_id bigint, name string, value string, type int")
