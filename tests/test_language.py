"""The query language: parser, positional operators and compiler, over a tiny hand-written collection."""

from dataclasses import replace
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanforge.model import ATTRIBUTE_DDL, CORPUS_DDL, DOCUMENT_ATTRIBUTE_DDL, DOCUMENT_CORPUS_DDL, DOCUMENT_DDL, SPAN_DDL, Catalog
from spanforge.operators.location import locate, overlap_count, predicate
from spanforge.operators.search import kwic, search
from spanforge.plans.compiler import Options, compile_query
from spanforge.plans.parser import INF, POSITIONAL, Location, Logical, Pair, QueryError, parse, parse_batch

WORDS = {1: "ad mater sic sic mater 100 it's per%cent".split(), 2: "sic leniter leviter".split()}


def span(i, doc, kind, p1, p2, value, pos=None, lemma=None):
    return (i, doc, kind, p1, p2, p1 * 10, len(value), "la", pos, lemma, value, value)


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [span(d * 100 + k, d, "tok", k, k, w, "NOUN" if w == "mater" else None) for d, ws in WORDS.items() for k, w in enumerate(ws, 1)]
    rows += [span(150, 1, "l", 1, 4, ""), span(151, 1, "l", 5, 8, ""), span(152, 1, "lg", 1, 8, ""), span(250, 2, "l", 1, 3, "")]
    attrs = [(101, 1, "len", "2", 1), (102, 1, "len", " 5 ", 1), (103, 1, "len", "1d", 0), (103, 1, "gn", "x", 0), (203, 2, "len", "7", 1), (152, 1, "n", "1", 0)]
    e = Catalog.empty(spark)
    return replace(
        e,
        document=spark.createDataFrame([(1, "Catullus", "carmina", "a", "p", None, -54.0, "catullus", None, ""), (2, "Horatius", "odes", "b", "p", None, -30.0, "horatius", None, "")], DOCUMENT_DDL),
        document_attribute=spark.createDataFrame([(1, "cat", "poetry", 0), (1, "year", "10", 1), (2, "year", "x", 0)], DOCUMENT_ATTRIBUTE_DDL),
        corpus=spark.createDataFrame([("Alpha", "A", "", None)], CORPUS_DDL),
        document_corpus=spark.createDataFrame([(1, "Alpha")], DOCUMENT_CORPUS_DDL),
        span=spark.createDataFrame(rows, SPAN_DDL),
        span_attribute=spark.createDataFrame(attrs, ATTRIBUTE_DDL),
    )


CASES = {
    '[value="SIC"]': [103, 104, 201],
    '[value<>"sic"]': [101, 102, 105, 106, 107, 108, 202, 203],
    '[value*="at"]': [102, 105],
    '[value^="le"]': [202, 203],
    '[value$="ter"]': [102, 105, 202, 203],
    '[value?="le*ter"]': [202, 203],
    '[value?="s?c"]': [103, 104, 201],
    '[value?="sic"]': [103, 104, 201],
    '[value~="^m.t"]': [102, 105],
    '[value%="lenitre:0.4"]': [202],
    '[value="it\'s"]': [107],
    '[value?="per%*"]': [108],
    '[pos="noun"]': [102, 105],
    '[len>"2"]': [102, 203],
    '[len=="5"]': [102],
    '[len="2"]': [101],
    "[gn]": [103],
    "[$l]": [150, 151, 250],
    '[$name="lg"]': [152],
    "[$lg] AND [_n]": [152],
    '[$lg] AND [_n="2"]': [],
    '[value="sic"] AND [gn]': [103],
    '[value="sic"] AND NOT [gn]': [104, 201],
    '[gn] OR [pos="NOUN"]': [102, 103, 105],
    '[p1=="3"]': [103, 203],
    '[p1="3"] AND [value="sic"]': [103],
    '[value="&0073;ic"] AND [p1<"4"]': [103, 201],
    '[value="sic"] OR [value="mater"] AND [len]': [102, 103],
    '@[author="catullus"]; [value="sic"]': [103, 104],
    '@[cat="poetry"] AND [year=="10"]; [value="sic"]': [103, 104],
    '@[cat] OR NOT [year=="10"]; [value="sic"]': [103, 104, 201],
    '@[date_value>"-40"]; [value="sic"]': [201],
    '@[id="2"]; [value="sic"]': [201],
    '@([author="x"] OR [title*="ode"]) AND [year]; [value="sic"]': [201],
    '@@ALPHA beta; [value="sic"]': [103, 104],
    '@@alpha; @[author="Horatius"]; [value="sic"]': [],
    '[value="sic"] BEFORE(m=0) [value="mater"]': [104],
    '[value="sic"] NOT BEFORE(m=0) [value="mater"]': [103, 201],
    '[value="sic"] AFTER(m=0) [value="mater"]': [103],
    '[value="sic"] NEAR(m=0) [value="mater"]': [103, 104],
    '[value="sic"] NEAR(m=0,s=l) [value="mater"]': [103],
    '[value="mater"] INSIDE(me=0) [$l]': [],
    '[value="mater"] INSIDE(ms=0) [$l]': [105],
    '[value$="ter"] INSIDE() [$l]': [102, 105, 202, 203],
    '[value="sic"] BEFORE(m=0) [value="mater"] OR [value="sic"]': [103, 104],
    '[value="sic"] BEFORE() [value="mater"] AFTER(m=1) [value="ad"]': [103],
    '([value="sic"] BEFORE(m=0) [value="mater"]) OR [value="ad"]': [101, 104],
    '([value="sic"] BEFORE(m=0) [value="mater"]) AND NOT [gn]': [104],
}


@pytest.mark.parametrize("query", CASES)
def test_queries(catalog, query):
    assert sorted(r["id"] for r in compile_query(catalog, query).collect()) == CASES[query]


def test_or_not(catalog):
    def found(o):
        return sorted(r["id"] for r in compile_query(catalog, '[gn] OR NOT [value~="i"]', o).collect())

    assert found(Options()) == [101, 102, 103, 105, 106, 108]
    assert found(Options(or_not_is_or=True)) == [103, 104, 107, 201, 202, 203]


def test_precedence():
    tree = parse('[a="1"] BEFORE() [b="2"] OR [c="3"] NOT NEAR(m=2) [d]').text
    assert isinstance(tree, Location) and tree.op == "NEAR" and tree.negated and tree.args == {"n": 0, "m": 2}
    assert tree.left.op == "BEFORE" and isinstance(tree.left.right, Logical) and isinstance(tree.right, Pair)


@pytest.mark.parametrize(
    "query",
    ["", "[value", '[value="a]', '[value="a"] trailing', '[value="a"] NEAR(n=2,m=1) [b]', '[a="b"] INSIDE(n=1) [$c]', '[a="b"] NOT NEAR(s=l) [c]', "@@; [a]", '[a="b"] NEAR(m=1,m=2) [c]', '[_n="1"]', '([a]'],
)
def test_faults(query):
    with pytest.raises(QueryError) as e:
        parse(query)
    assert e.value.line == 1


@pytest.mark.parametrize("query", ['[p1*="1"]', '[len>"x"]', "[value]", "@[author]; [value=\"a\"]"])
def test_faults_of_meaning(catalog, query):
    with pytest.raises(QueryError):
        compile_query(catalog, query)


def test_fault_place():
    with pytest.raises(QueryError) as e:
        parse('[a="b"]\n  AND ?')
    assert (e.value.line, e.value.column) == (2, 7)


def test_batch():
    assert parse_batch('sic\n\n[a="b"]\nOR [c]\n\n\n') == ['[value="sic"]', '[a="b"] OR [c]']


def test_truth_table(spark):
    rows = [((2, 4, 2, 4), 3), ((2, 4, 3, 5), 2), ((2, 4, 1, 2), 1), ((2, 2, 3, 3), 0)]
    for (a1, a2, b1, b2), n in rows:
        assert spark.range(1).select(overlap_count(F.lit(a1), F.lit(a2), F.lit(b1), F.lit(b2))).first()[0] == n


def holds(op, args, a, b):
    n, m = args.get("n", 0), args.get("m", INF)
    if op == "INSIDE":
        return b[0] <= a[0] and a[1] <= b[1] and args.get("ns", 0) <= a[0] - b[0] <= args.get("ms", INF) and args.get("ne", 0) <= b[1] - a[1] <= args.get("me", INF)
    before, after = b[0] - a[1] - 1, a[0] - b[1] - 1
    if op in ("BEFORE", "AFTER", "NEAR"):
        return (op != "AFTER" and before >= 0 and n <= before <= m) or (op != "BEFORE" and after >= 0 and n <= after <= m)
    if op == "OVERLAPS":
        k = min(a[1], b[1]) - max(a[0], b[0]) + 1
        return k > 0 and n <= k <= m
    d = a[0] - b[0] if op == "LALIGN" else b[1] - a[1]
    return d >= 0 and n <= d <= m


ARGS = [{}, {"n": 1}, {"m": 2}, {"n": 1, "m": 3}]
INSIDE_ARGS = [{}, {"ns": 1}, {"ne": 1}, {"ms": 1}, {"me": 0}]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 12), st.integers(0, 4)), min_size=1, max_size=12), st.lists(st.tuples(st.integers(1, 3), st.integers(1, 12), st.integers(0, 4)), min_size=0, max_size=12))
def test_strategies_agree(spark, left, right):
    def frame(rows):
        return spark.createDataFrame([span(k, d, "x", p, p + w, "") for k, (d, p, w) in enumerate(rows)], SPAN_DDL).select("id", "document_id", "type", "p1", "p2", "index", "length", "value")

    a, b = frame(left), frame(right)
    out, expected = None, {}
    for op in POSITIONAL:
        for args, negated in product(INSIDE_ARGS if op == "INSIDE" else ARGS, (False, True)):
            for strategy in ("auto", "join"):
                key = f"{op} {args} {negated} {strategy}"
                expected[key] = sorted(
                    k for k, (d, p, w) in enumerate(left) if any(d == e and holds(op, args, (p, p + w), (q, q + v)) for e, q, v in right) != negated
                )
                if strategy == "join" or args in ({"n": 1, "m": 3}, {"ne": 1}):
                    own = locate(a, b, op, args, negated, strategy=strategy).select(F.lit(key).alias("key"), "id")
                    out = own if out is None else out.unionByName(own)
    got = {}
    for r in out.collect():
        got.setdefault(r["key"], []).append(r["id"])
    tried = {k for k in expected if k.endswith("join") or k in got}
    assert {k: sorted(got.get(k, [])) for k in tried} == {k: expected[k] for k in tried}


@pytest.mark.parametrize("op", POSITIONAL)
def test_sweep_of_repeated_rows(spark, op):
    rows = [span(1, 1, "x", 3, 4, ""), span(1, 1, "x", 3, 4, ""), span(2, 1, "x", 9, 9, "")]
    a = spark.createDataFrame(rows, SPAN_DDL)
    b = spark.createDataFrame([span(5, 1, "y", 1, 2, ""), span(6, 1, "y", 3, 5, ""), span(7, 1, "y", 8, 9, "")], SPAN_DDL)
    for args in ({}, {"n": 1}) if op != "INSIDE" else ({}, {"ns": 1}):
        want = sorted(r[0] for r in rows if any(holds(op, args, (r[3], r[4]), q) for q in ((1, 2), (3, 5), (8, 9))))
        assert sorted(r["id"] for r in locate(a, b, op, args).collect()) == want


def test_predicate_names():
    with pytest.raises(ValueError):
        predicate("ABOVE", {}, *(F.lit(1),) * 4)


def test_search_and_kwic(catalog):
    page, total = search(catalog, '[value="sic"]', size=2)
    assert total == 3 and [r["id"] for r in page.collect()] == [103, 104]
    page, _ = search(catalog, '[value="sic"]', page=2, size=2)
    (row,) = kwic(page, catalog, 2).collect()
    assert (row["id"], row["left"], row["right"]) == (201, ["", ""], ["leniter", "leviter"])
    page, _ = search(catalog, '[value="sic"]', sort=("-date_value", "year", "p1"))
    assert [r["id"] for r in page.collect()] == [201, 103, 104]
    for bad in ({"page": 0}, {"size": 0}, {"size": 101}):
        with pytest.raises(ValueError):
            search(catalog, '[value="sic"]', **bad)
