"""From a query's syntax tree to a lazy plan.

A tree of pairs and logical operators becomes one scan of the spans with one condition: AND, OR and NOT of span sets are
those of conditions on a span.  Attributes that such a tree asks for are gathered in one aggregation over the spans' attributes
and joined once, or semi joined where there is one alone; where an index has them as columns of the spans, they are part of the
scan.  Positional operators join such sets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.text import like_pattern, normalise_literal, to_number, trigram_at_least
from spanforge.model import ATTRIBUTE, DOCUMENT_PRIVILEGED, NUMERIC_PRIVILEGED, SPAN_PRIVILEGED, Catalog
from spanforge.operators.location import SPAN, locate, locate_within, sweepable
from spanforge.plans.parser import NUMERIC_OPS, Location, Logical, Pair, Query, QueryError, parse

FUZZY_THRESHOLD = 0.9


@dataclass(frozen=True)
class Options:
    """or_not_is_or: OR NOT as a plain OR.  literals: normalise the literals of =, *=, ^= and $= as tokens are.
    strategy: of positional operators."""

    or_not_is_or: bool = False
    literals: bool = True
    strategy: str = "auto"


def compare(column: Column, op: str, value: str, numeric: bool = False, literals: bool = True) -> Column:
    """A column of text (or a number, if numeric) against the literal of a query."""
    if op in NUMERIC_OPS:
        try:
            number = float(value)
        except ValueError:
            raise QueryError(f"{value!r} is not a number") from None
        left = column.cast("double") if numeric else to_number(column)
        return {"==": left == number, "!=": left != number, "<": left < number, "<=": left <= number, ">": left > number, ">=": left >= number}[op]
    if numeric and op in ("=", "<>"):
        left, number = column.cast("double"), F.lit(value).try_cast("double")
        return left == number if op == "=" else left != number
    if numeric:
        raise QueryError(f"the operator {op} can't be used on numbers")
    low = F.lower(column)
    plain = (normalise_literal(value) if literals else value).lower()
    if op == "=":
        return low == plain
    if op == "<>":
        return low != value.lower()
    if op == "*=":
        return low.contains(plain)
    if op == "^=":
        return low.startswith(plain)
    if op == "$=":
        return low.endswith(plain)
    if op == "?=":
        return low.like(like_pattern(value.lower())) if set(value) & set("*?") else low == plain
    if op == "~=":
        return column.rlike(value)
    if op == "%=":
        text, _, threshold = value.rpartition(":")
        try:
            return trigram_at_least(column, text, float(threshold)) if text else trigram_at_least(column, value, FUZZY_THRESHOLD)
        except ValueError:
            return trigram_at_least(column, value, FUZZY_THRESHOLD)
    raise QueryError(f"no operator {op}")


def _attribute_test(pair: Pair, literals: bool) -> Column:
    named = F.lower("name") == pair.name.lower()
    return named if pair.op is None else named & compare(F.col("value"), pair.op, pair.value, literals=literals)


# documents


def filter_documents(catalog: Catalog, tree: object, options: Options = Options()) -> DataFrame:
    """The ids of the documents that a document section selects."""
    open_pairs: list[Pair] = []

    def condition(node: object) -> Column:
        if isinstance(node, Logical):
            left = condition(node.left)
            if node.op == "NOT":
                return ~left
            right = condition(node.right)
            return {"AND": lambda: left & right, "OR": lambda: left | right, "AND NOT": lambda: left & ~right, "OR NOT": lambda: left | ~right}[node.op]()
        name = node.name.lower()
        if name in DOCUMENT_PRIVILEGED or name == "id":
            if node.op is None:
                raise QueryError(f"{name} is there in all documents")
            numeric = name in ("date_value", "id")
            column = F.col("document.id") if name == "id" else F.col(name)
            if numeric and node.op not in NUMERIC_OPS and node.op not in ("=", "<>"):
                column, numeric = column.cast("string"), False
            return F.coalesce(compare(column, node.op, node.value, numeric, literals=False), F.lit(False))
        if node not in open_pairs:
            open_pairs.append(node)
        return F.coalesce(F.col(f"__a{open_pairs.index(node)}"), F.lit(False))

    test = condition(tree)
    d = catalog.document.alias("document")
    if open_pairs:
        tests = [_attribute_test(p, literals=False) for p in open_pairs]
        some = tests[0]
        for t in tests[1:]:
            some = some | t
        flags = catalog.document_attribute.filter(some).groupBy(F.col("document_id").alias("__doc")).agg(
            *(F.max(F.coalesce(t, F.lit(False))).alias(f"__a{k}") for k, t in enumerate(tests))
        )
        d = d.join(flags, F.col("document.id") == F.col("__doc"), "left")
    return d.filter(test).select(F.col("document.id").alias("document_id"))


def scope(catalog: Catalog, query: Query, options: Options = Options()) -> DataFrame | None:
    """Ids of the documents that a query is about, or None for all."""
    ids = None
    if query.corpora:
        ids = catalog.document_corpus.filter(F.lower("corpus_id").isin(*query.corpora)).select("document_id").distinct()
    if query.documents is not None:
        own = filter_documents(catalog, query.documents, options)
        ids = own if ids is None else own.join(ids, "document_id", "left_semi")
    return ids


# spans


class _Compiler:
    def __init__(self, catalog: Catalog, query: Query, options: Options):
        self.catalog, self.options = catalog, options
        self.scope = scope(catalog, query, options)
        self.spans = self.within(catalog.span)

    def within(self, df: DataFrame) -> DataFrame:
        return df if self.scope is None else df.join(self.scope, "document_id", "left_semi")

    def set_of(self, node: object) -> DataFrame:
        if isinstance(node, Location):
            if not node.structure and self.options.strategy != "join" and self.is_plain(node.left) and self.is_plain(node.right) and sweepable(node.op, node.args):
                asked: list[Pair] = []
                tests = self.condition(node.left, asked), self.condition(node.right, asked)
                if not asked or self.catalog.wide is not None:
                    sides = (self.flagged(asked) if asked else self.spans).select(*SPAN, tests[0].alias("__left"), tests[1].alias("__right"))
                    return locate_within(sides, F.col("__left"), F.col("__right"), node.op, node.args, node.negated).select(*SPAN)
            left, right = self.set_of(node.left), self.set_of(node.right)
            structures = self.spans.filter(F.col("type") == node.structure) if node.structure else None
            return locate(left, right, node.op, node.args, node.negated, structures, self.options.strategy)
        if self.is_plain(node):
            return self.scan(node)
        left, right = self.set_of(node.left), self.set_of(node.right)
        if node.op == "AND":
            return left.join(right.select("id"), "id", "left_semi").select(*SPAN)
        if node.op == "AND NOT":
            return left.join(right.select("id"), "id", "left_anti").select(*SPAN)
        if node.op == "OR NOT" and not self.options.or_not_is_or:
            tokens = self.spans.filter("type = 'tok'").select(*SPAN)
            right = tokens.join(right.select("id"), "id", "left_anti").select(*SPAN)
        return left.unionByName(right).dropDuplicates(["id"])

    def is_plain(self, node: object) -> bool:
        if isinstance(node, Logical):
            return self.is_plain(node.left) and self.is_plain(node.right)
        return isinstance(node, Pair)

    def scan(self, node: object) -> DataFrame:
        open_pairs: list[Pair] = []
        test = self.condition(node, open_pairs)
        spans = self.spans
        if open_pairs and self.catalog.wide is not None:
            return self.flagged(open_pairs).filter(test).select(*SPAN)
        if open_pairs and isinstance(node, Pair):
            ids = self.catalog.span_attribute.filter(_attribute_test(node, self.options.literals)).select(F.col("span_id").alias("id"))
            kind = F.col("type") == (node.structure or "tok")
            return spans.filter(kind).join(ids, "id", "left_semi").select(*SPAN)
        if open_pairs:
            tests = [_attribute_test(p, self.options.literals) for p in open_pairs]
            some = tests[0]
            for t in tests[1:]:
                some = some | t
            flags = self.catalog.span_attribute.filter(some).groupBy(F.col("span_id").alias("id")).agg(
                *(F.max(F.coalesce(t, F.lit(False))).alias(f"__a{k}") for k, t in enumerate(tests))
            )
            spans = spans.join(flags, "id", "left")
        return spans.filter(test).select(*SPAN)

    def flagged(self, open_pairs: list[Pair]) -> DataFrame:
        """The spans with a column for each pair that asks for an attribute, where attributes are columns of the spans."""
        wide, flags = self.catalog.wide, {}
        for k, p in enumerate(open_pairs):
            column = next((c for c in wide.columns if c.lower() == ATTRIBUTE + p.name.lower()), None)
            there = F.lit(False) if column is None else F.col(column).isNotNull()
            if column is not None and p.op is not None:
                there = there & F.coalesce(compare(F.col(column), p.op, p.value, literals=self.options.literals), F.lit(False))
            flags[f"__a{k}"] = there
        return self.within(wide).withColumns(flags)

    def condition(self, node: object, open_pairs: list[Pair]) -> Column:
        """A condition that is never null."""
        if isinstance(node, Logical):
            left, right = self.condition(node.left, open_pairs), self.condition(node.right, open_pairs)
            if node.op == "AND":
                return left & right
            if node.op == "AND NOT":
                return left & ~right
            if node.op == "OR NOT" and not self.options.or_not_is_or:
                return left | ((F.col("type") == "tok") & ~right)
            return left | right
        name = node.name.lower()
        if node.kind == "structure":
            return F.col("type") == node.structure
        kind = F.col("type") == (node.structure or "tok")
        if name in SPAN_PRIVILEGED:
            if node.op is None:
                raise QueryError(f"{name} is there in all spans, so it needs an operator and a value")
            numeric = name in NUMERIC_PRIVILEGED
            if numeric and node.op not in NUMERIC_OPS and node.op not in ("=", "<>"):
                raise QueryError(f"the operator {node.op} can't be used on {name}, which is a number")
            literals = self.options.literals and name in ("value", "lemma")
            return kind & F.coalesce(compare(F.col(name), node.op, node.value, numeric, literals), F.lit(False))
        if node not in open_pairs:
            open_pairs.append(node)
        return kind & F.coalesce(F.col(f"__a{open_pairs.index(node)}"), F.lit(False))


def compile_query(catalog: Catalog, query: str | Query, options: Options = Options()) -> DataFrame:
    """The spans that a query finds: id, document_id, type, p1, p2, index, length and value, each span once."""
    tree = parse(query) if isinstance(query, str) else query
    return _Compiler(catalog, tree, options).set_of(tree.text)
