"""Cases of what once differed from SQL, left something out or grew faster than its input."""

import random
from dataclasses import replace

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from spanforge import queries
from spanforge.analysis import markup, scan
from spanforge.analysis.tokens import full_tokens
from spanforge.functions import text as fn
from spanforge.index import Index
from spanforge.operators import corpora, lexicon, words
from spanforge.operators.location import locate
from spanforge.plans.compiler import compile_query


def lexicon_of(spark, values):
    return spark.createDataFrame([(k, v, v, v, "X") for k, v in enumerate(values)], lexicon.LEXICON_DDL)


def fuzzy_sql(values, text, threshold):
    con = duckdb.connect()
    con.execute("CREATE TABLE v AS SELECT unnest(?::VARCHAR[]) AS value", [values])
    return sorted(r[0] for r in con.execute(f"SELECT value FROM v WHERE 1 - damerau_levenshtein(value, '{text}') / greatest(length(value), {len(text)}) >= {threshold}").fetchall())


def test_fuzzy_distance_is_that_of_sql(spark):
    assert fn.damerau_distance(b"ca", b"abc") == 2 and fn.damerau_distance("ß".encode(), b"s") == 2 and fn.damerau_distance(b"", b"ab") == 2
    values = ["nation", "aintion", "aention", "natoin", "natioß", "ßation", "notion", "nat", "tion"]
    got = sorted(r["value"] for r in lexicon.find(lexicon_of(spark, values), "nation", "fuzzy", 0.65).collect())
    assert "aintion" in got and got == fuzzy_sql(values, "nation", 0.65)


def test_fuzzy_finds_values_of_any_length(spark):
    values = ["nation", "nationxyz", "donations", "aneaution", "nationwxyz", "nat", "nati", "ationn", "x" * 60]
    for threshold in (0.65, 0.5, 0.3):
        got = sorted(r["value"] for r in lexicon.find(lexicon_of(spark, values), "nation", "fuzzy", threshold).collect())
        assert got == fuzzy_sql(values, "nation", threshold)
    assert lexicon.find(lexicon_of(spark, values), "nation", "fuzzy", 0.65).filter(F.length("value") == 9).count() == 3
    assert lexicon.find(lexicon_of(spark, values), "nation", "fuzzy", 0.0).count() == len(values)


ODD = [(1, "One, two. \"Three\"\r\n\n four's\t5 €  six;", "en"), (2, None, "en"), (3, "", "de"), (4, " \n ", None), (None, "Größe der Straße.", "de"), (5, "a b. c" * 40, "en"), (5, "again the fifth", "en")]
ODD_DDL = "doc_id bigint, text string, lang string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_and_structures_need_no_shuffle(spark):
    docs = spark.createDataFrame(ODD, ODD_DDL)
    assert "Exchange" not in plan(full_tokens(docs, "doc_id", "text", "lang"))
    assert "Exchange" not in plan(scan.structures(docs, "doc_id", "text", ("lang",), "line"))


def test_parts_of_texts_make_no_difference(spark, monkeypatch):
    texts = [t for _, t, _ in ODD] + ["x y.\nz " * 30]

    def found():
        out = []
        for t in scan.cut(texts):
            raw, value = (t.looks.column(c).take(pa.array(t.kind)).to_pylist() for c in ("raw", "value"))
            out += zip(t.text.tolist(), t.position.tolist(), t.index.tolist(), t.length.tolist(), t.line.tolist(), t.sentence.tolist(), raw, value)
        return out

    whole = found()
    assert whole[:7] == [(0, 1, 0, 4, 1, 1, "One,", "one"), (0, 2, 5, 4, 1, 1, "two.", "two"), (0, 3, 10, 7, 1, 2, '"Three"', "three"), (0, 4, 21, 6, 3, 2, "four's", "four's"), (0, 5, 28, 1, 3, 2, "5", "5"), (0, 6, 30, 1, 3, 2, "€", "€"), (0, 7, 33, 4, 3, 2, "six;", "six")]
    assert all(t[t_index : t_index + n] == raw for k, _, t_index, n, _, _, raw, _ in whole for t in [texts[k]])
    for size in (5, 23):
        monkeypatch.setattr(scan, "CHARACTERS", size)
        assert found() == whole


def index_over(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    return Index(spark, str(tmp_path))


def test_index_of_odd_documents(spark, tmp_path):
    docs = spark.createDataFrame(ODD, ODD_DDL).withColumns({"source": F.concat(F.lit("s"), (F.col("doc_id") % 2).cast("string")), "n_chars": F.length("text")})
    x = index_over(spark, tmp_path, docs)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    columns = ("word_id", "lemma_id", "doc_attr_name", "doc_attr_value", "count")
    counted = words.count_words(words.index_tokens(x.catalog()), x.document_pairs()).select(*columns)
    assert rows(x.counted().select(*columns)) == rows(counted) != []
    words.SENT_CLASSES, kept = 0, words.SENT_CLASSES
    try:
        assert rows(x.counted().select(*columns)) == rows(counted)
    finally:
        words.SENT_CLASSES = kept
    assert rows(x.word()) == rows(words.build_words(words.index_tokens(x.catalog())).select(*x.word().columns))
    same = ("id", "word_id", "lemma_id")
    assert rows(x.assigned().select(*same)) == rows(words.assign_words(x.token_spans(), x.word()).select(*same))
    for kind, by in (("par", "line"), ("snt", "sentence")):
        own = full_tokens(docs, "doc_id", "text", "lang").filter("doc_id <> 5").groupBy("doc_id", by).agg(F.min("position"), F.max("position"), F.min("index"), F.max(F.col("index") + F.col("length")) - F.min("index")).drop(by)
        assert rows(own) == rows(x.structures(kind).filter("document_id <> 5").select("document_id", "p1", "p2", "index", "length"))


def test_attributes_and_one_word_are_asked_of_the_scan(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The nation, the end", "en"), (2, "other words", "en")], ODD_DDL).withColumns({"source": F.lit("s"), "n_chars": F.length("text")})
    x = index_over(spark, tmp_path, docs)
    found = compile_query(x.catalog(), '[value="the"] OR NOT [len>"3"]')
    assert "Join" not in plan(found) and sorted(r["value"] for r in found.collect()) == ["end", "the", "the"]
    assert [r["value"] for r in compile_query(x.catalog(), "[RP]").collect()] == ["nation"] and compile_query(x.catalog(), "[none]").count() == 0
    of_the = queries._distribution(x)
    assert [tuple(r) for r in of_the.collect()] == [("s", 2)]
    c = x.vocabulary()
    one, general = ({r["name"]: r["value"] for r in words.statistics(k).collect()} for k in (c, replace(c)))
    assert one == general and one["span_tok_attribute_count"] == 7 and c.wide is not None
    assert "word_count" not in x.frames


def test_trigrams_are_made_of_likely_words_alone(spark):
    values = ["nation", "Nation's", "national", "ration", "on na", "n", "", None, "nat.ion", "xx nation yy zz"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for t in (0.0, 0.2, 0.4, 0.9, 1.0, 1.1):
        rows = df.select(fn.trigram_at_least(F.col("v"), "nation", t).alias("a"), (fn.trigram_similarity(F.col("v"), "nation") >= t).alias("b")).collect()
        assert [r["a"] for r in rows] == [r["b"] for r in rows]
    assert "contains" in plan(df.filter(fn.trigram_at_least(F.col("v"), "nation", 0.4))).lower()


def test_texts_leave_workers_in_parts(spark, monkeypatch):
    monkeypatch.setattr(markup, "CHARACTERS", 10)
    batches = [pa.array(["<b>x</b>", None, "<i>", "y" * 30, "z"]), pa.array([], pa.string()), pa.array([None], pa.string())]
    parts = list(markup.in_parts(markup.fill_tags, iter(batches)))
    assert [len(p) for p in parts] == [3, 1, 1, 0, 1] and [x for p in parts for x in p.to_pylist()] == ["   x    ", None, "   ", "y" * 30, "z", None]
    df = spark.createDataFrame([(k, None if k % 7 == 0 else f"<p>{k}</p>") for k in range(100)], "k int, t string").repartition(3)
    assert all(r["o"] == (None if r["k"] % 7 == 0 else f"   {r['k']}    ") for r in df.select("k", markup.on_text(markup.fill_tags, F.col("t")).alias("o")).collect())


def test_bounded_inside_meets_on_pages(spark):
    random.seed(4)
    spans = [(k, random.choice([1, 2]), a, a + random.randrange(90)) for k, a in enumerate(random.choices(range(1500), k=400))]
    df = spark.createDataFrame(spans, "id bigint, document_id bigint, p1 int, p2 int")
    for args in ({"ms": 1, "ne": 2}, {"ns": 3, "ms": 70}, {"me": 5}, {"ns": 1, "ms": 200, "ne": 1, "me": 40}, {"ns": 2, "ms": 1}):
        ns, ms, ne, me = (args.get(k, d) for k, d in (("ns", 0), ("ms", 1 << 30), ("ne", 0), ("me", 1 << 30)))
        expected = sorted(a[0] for a in spans if any(a[1] == b[1] and ns <= a[2] - b[2] <= ms and ne <= b[3] - a[3] <= me for b in spans))
        found = locate(df, df, "INSIDE", args)
        assert sorted(r["id"] for r in found.collect()) == expected and "page" in plan(found)
        assert locate(df, df, "INSIDE", args, negated=True).count() == len(spans) - len(expected)


def test_ranges_of_odd_tokens(spark):
    random.seed(3)
    tokens = [(d, "tok", i, i // 7 + random.choice([0, 0, 0, d]), i // 7 + random.choice([0, 0, 2 * d])) for d in (0, 1, 2) for i in sorted(random.sample(range(20000), 700))]
    tokens += [(9, "tok", 10 * k, k + 1, k + 1) for k in range(1500)] + [(9, "par", 0, 1, 1500), (None, "tok", 1, 1, 1)]
    mixed = random.sample(tokens, len(tokens))
    ranges = [(d, k, a, a + n) for k, (d, a, n) in enumerate((random.choice([0, 1, 2, 9, 5]), random.randrange(21000), random.choice([0, 1, 30, 5000, 9000])) for _ in range(150))]
    ddl = "document_id bigint, type string, index int, p1 int, p2 int"
    for own in (tokens, mixed):
        found = corpora.positions_of_ranges(spark.createDataFrame(own, ddl).coalesce(1), spark.createDataFrame(ranges, "document_id bigint, range_id int, start int, end int")).collect()
        for r in found:
            inside = [t for t in tokens if t[1] == "tok" and t[0] == r["document_id"] and r["start"] <= t[2] < r["end"]]
            assert (r["p1"], r["p2"]) == ((min(t[3] for t in inside), max(t[4] for t in inside)) if inside else (None, None))
        assert len(found) == len(ranges)
    runs = list(corpora._runs(iter([pa.record_batch([pa.array([x[k] for x in tokens if x[0] == 9 and x[1] == "tok"]) for k in (0, 2, 3, 4)], ["d", "i", "p", "q"])])))
    assert runs[0].num_rows == runs[0]["p1s"].null_count == -(-15000 // corpora.PAGE)  # a row for a page, without positions


def test_ranges_of_texts_are_those_of_their_tokens(spark, tmp_path):
    docs = spark.createDataFrame([*ODD, (7, "long words\n" * 900, "en")], ODD_DDL).withColumns({"source": F.lit("s"), "n_chars": F.length("text")})
    x = index_over(spark, tmp_path, docs)
    ranges = spark.createDataFrame([(d, k, 150 * k, 150 * k + 150) for d in (1, 2, 5, 7) for k in range(70)] + [(7, 99, 20, 9000)], "document_id bigint, range_id int, start int, end int")
    one, general = ({(r["document_id"], r["range_id"]): (r["p1"], r["p2"]) for r in found.collect()} for found in (corpora.ranges_on_pages(x.pages(), ranges), corpora.positions_of_ranges(x.token_spans(), ranges)))
    assert one == general and len(one) == 281 and one[7, 99] == (5, 1637)
