"""The query language: text to syntax tree.

    @@corpus ...;  @document pairs;  [pair] op [pair] ...

Logical operators (AND, OR, AND NOT, OR NOT) bind tighter than positional ones (BEFORE(...) and so on); each level goes
from left to right.  In the document section AND binds tighter than OR, as in SQL.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

INF = 2147483647
COMPARISONS = ("==", "!=", "<=", ">=", "<>", "*=", "^=", "$=", "?=", "~=", "%=", "=", "<", ">")
NUMERIC_OPS = ("==", "!=", "<", "<=", ">", ">=")
POSITIONAL = ("NEAR", "BEFORE", "AFTER", "INSIDE", "OVERLAPS", "LALIGN", "RALIGN")
LOGICAL = ("AND", "OR", "AND NOT", "OR NOT")


class QueryError(ValueError):
    """A fault in a query, with its place in the text (line and column from 1)."""

    def __init__(self, message: str, text: str = "", index: int = 0, length: int = 1):
        self.line = text.count("\n", 0, index) + 1
        self.column = index - (text.rfind("\n", 0, index) + 1) + 1
        self.index, self.length = index, length
        super().__init__(f"{message} (line {self.line}, column {self.column})")


@dataclass(frozen=True)
class Pair:
    """[name op value]; kind: 'token', 'structure' ([$name]) or 'structure_attribute' ([_name ...])."""

    name: str
    op: str | None = None
    value: str | None = None
    kind: str = "token"
    structure: str | None = None
    index: int = 0
    length: int = 0


@dataclass(frozen=True)
class Logical:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Location:
    op: str
    negated: bool
    args: dict[str, int] = field(hash=False)
    structure: str | None
    left: object = None
    right: object = None


@dataclass(frozen=True)
class Query:
    corpora: tuple[str, ...]
    documents: object | None
    text: object


@dataclass(frozen=True)
class _Raw:
    name: str
    op: str | None
    value: str | None
    index: int
    length: int


@dataclass(frozen=True)
class _Token:
    kind: str
    value: str | _Raw
    index: int


_LEXER = re.compile(
    r"""(?P<blank>\s+)|(?P<corpora>@@)|(?P<at>@)|(?P<end>;)|(?P<open>\()|(?P<close>\))|(?P<pair>\[)
    |(?P<word>[A-Za-z]+)|(?P<eq>=)|(?P<comma>,)|(?P<number>\d+)|(?P<id>[^\s;()\[\]@=,]+)""",
    re.X,
)
_NAME = re.compile(r"[$_]?[^\W\d][\w\-]*", re.U)
_ESCAPE = re.compile(r"&([0-9A-Fa-f]{1,4});")


def unescape(value: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)), value)


class _Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.tokens = self._lex()
        self.structure: str | None = None

    def _fail(self, message: str, index: int | None = None, length: int = 1) -> QueryError:
        at = index if index is not None else (self.tokens[self.at].index if self.at < len(self.tokens) else len(self.text))
        return QueryError(message, self.text, at, length)

    def _lex(self) -> list:
        out: list = []
        i, text = 0, self.text
        self.tokens = out
        while i < len(text):
            if out and out[-1].kind == "corpora":  # corpus names up to the semicolon
                end = text.find(";", i)
                if end < 0:
                    raise QueryError("the corpora must end with ;", text, i)
                for m in re.finditer(r"\S+", text[i:end]):
                    out.append(_Token("id", m[0], i + m.start()))
                out.append(_Token("end", ";", end))
                i = end + 1
                continue
            m = _LEXER.match(text, i)
            if not m:
                raise QueryError(f"unexpected {text[i]!r}", text, i)
            if m.lastgroup == "pair":
                pair, i = self._pair(i)
                out.append(pair)
                continue
            if m.lastgroup != "blank":
                out.append(_Token(m.lastgroup, m[0], i))
            i = m.end()
        return out

    def _pair(self, start: int):
        text, i = self.text, start + 1

        def skip(i: int) -> int:
            while i < len(text) and text[i].isspace():
                i += 1
            return i

        i = skip(i)
        m = _NAME.match(text, i)
        if not m:
            raise QueryError("a name is expected", text, i)
        name, i = m[0], skip(m.end())
        if i < len(text) and text[i] == "]":
            return _Token("pair", _Raw(name, None, None, start, i + 1 - start), start), i + 1
        op = next((o for o in COMPARISONS if text.startswith(o, i)), None)
        if op is None:
            raise QueryError("a comparison or ] is expected", text, i)
        i = skip(i + len(op))
        if i >= len(text) or text[i] not in "\"'":
            raise QueryError("a value in quotes is expected", text, i)
        quote, end = text[i], text.find(text[i], i + 1)
        if end < 0:
            raise QueryError(f"the value has no closing {quote}", text, i)
        value, i = unescape(text[i + 1 : end]), skip(end + 1)
        if i >= len(text) or text[i] != "]":
            raise QueryError("] is expected", text, i)
        return _Token("pair", _Raw(name, op, value, start, i + 1 - start), start), i + 1

    # syntax

    def peek(self, kind: str, value: str | None = None) -> bool:
        if self.at >= len(self.tokens):
            return False
        t = self.tokens[self.at]
        return t.kind == kind and (value is None or str(t.value).upper() == value)

    def take(self, kind: str, value: str | None = None) -> _Token:
        if not self.peek(kind, value):
            raise self._fail(f"{value or kind} is expected")
        self.at += 1
        return self.tokens[self.at - 1]

    def query(self) -> Query:
        corpora: list[str] = []
        documents = None
        if self.peek("corpora"):
            self.at += 1
            while self.peek("id"):
                corpora.append(self.take("id").value.lower())
            self.take("end")
            if not corpora:
                raise self._fail("a corpus is expected")
        if self.peek("at"):
            self.at += 1
            documents = self.documents()
            self.take("end")
        tree = self.text_expression()
        if self.at < len(self.tokens):
            raise self._fail("unexpected text after the query")
        return Query(tuple(corpora), documents, tree)

    def logical_op(self) -> str | None:
        for word in ("AND", "OR"):
            if self.peek("word", word):
                self.at += 1
                if self.peek("word", "NOT"):
                    self.at += 1
                    return f"{word} NOT"
                return word
        return None

    def documents(self):
        """OR of ANDs; OR NOT and AND NOT negate their right side."""

        def factor():
            if self.peek("open"):
                self.at += 1
                inner = self.documents()
                self.take("close")
                return inner
            return self.pair()

        def term(left):
            while self.peek("word", "AND"):
                op = self.logical_op()
                left = Logical(op, left, factor())
            return left

        tree = term(factor())
        while self.peek("word", "OR"):
            op = self.logical_op()
            right = factor()
            tree = Logical("OR", tree, term(Logical("NOT", right, None) if op == "OR NOT" else right))
        return tree

    def text_expression(self):
        left = self.logical()
        while True:
            at = self.at
            negated = self.peek("word", "NOT")
            if negated:
                self.at += 1
            if not (self.at < len(self.tokens) and self.tokens[self.at].kind == "word"):
                self.at = at
                return left
            token = self.tokens[self.at]
            op = token.value.upper()
            if op not in POSITIONAL:
                if negated:
                    raise self._fail("a positional operator is expected")
                self.at = at
                return left
            self.at += 1
            args, structure = self.arguments(op, negated, token)
            left = Location(op, negated, args, structure, left, self.logical())

    def arguments(self, op: str, negated: bool, token: _Token) -> tuple[dict[str, int], str | None]:
        allowed = ("ns", "ms", "ne", "me", "s") if op == "INSIDE" else ("n", "m", "s")
        args: dict[str, int] = {"ns": 0, "ms": INF, "ne": 0, "me": INF} if op == "INSIDE" else {"n": 0, "m": INF}
        structure, seen = None, set()
        self.take("open")
        while not self.peek("close"):
            name = self.take("word").value.lower()
            if name not in allowed:
                raise self._fail(f"{op} has no argument {name}", self.tokens[self.at - 1].index, len(name))
            if name in seen:
                raise self._fail(f"the argument {name} is there twice", self.tokens[self.at - 1].index, len(name))
            seen.add(name)
            self.take("eq")
            if name == "s":
                structure = self.take("word" if self.peek("word") else "id").value
            else:
                args[name] = int(self.take("number").value)
            if not self.peek("close"):
                self.take("comma")
        self.take("close")
        for low, high in (("n", "m"), ("ns", "ms"), ("ne", "me")):
            if low in args and args[low] > args[high]:
                raise self._fail(f"{low} exceeds {high}", token.index, len(op))
        if structure and negated:
            raise self._fail("s can't be used with NOT", token.index, len(op))
        return args, structure

    def logical(self):
        left = self.primary()
        while op := self.logical_op():
            left = Logical(op, left, self.primary())
        return left

    def primary(self):
        if self.peek("open"):
            self.at += 1
            inner = self.text_expression()
            self.take("close")
            return inner
        return self.pair()

    def pair(self) -> Pair:
        raw = self.take("pair").value
        if raw.name.startswith("$"):
            # [$name="lg"] and [$lg] both mean structures of type lg; with another name the value is the type too
            kind = raw.name[1:] if raw.op is None else raw.value
            self.structure = kind
            return Pair(raw.name[1:], raw.op, raw.value, "structure", kind, raw.index, raw.length)
        if raw.name.startswith("_"):
            if self.structure is None:
                raise QueryError("a structure must come before its attribute", self.text, raw.index, raw.length)
            return Pair(raw.name[1:], raw.op, raw.value, "structure_attribute", self.structure, raw.index, raw.length)
        return Pair(raw.name, raw.op, raw.value, "token", None, raw.index, raw.length)


def parse(text: str) -> Query:
    return _Parser(text).query()


def parse_documents(text: str):
    """The tree of a document section alone, such as [lang="en"] AND [n_chars>"100"]."""
    parser = _Parser(text)
    tree = parser.documents()
    if parser.at < len(parser.tokens):
        raise parser._fail("unexpected text after the pairs")
    return tree


def parse_batch(text: str) -> list[str]:
    """Queries from a file: blank lines part them, and bare text asks for a value."""
    found = [" ".join(x.split("\n")).strip() for x in re.split(r"\n[ \t]*\n", text.replace("\r\n", "\n"))]
    return [q if q.startswith(("[", "@", "(")) else f'[value="{q}"]' for q in found if q]
