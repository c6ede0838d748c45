"""Words, corpora, lexicon, markup, reading, profiles, sources, the stream, and some registered queries against their SQL."""

import os
import subprocess
import sys
from dataclasses import replace

import pytest
from compare import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spanforge.analysis import markup, reading, tagged
from spanforge.analysis.tokens import full_tokens, token_stream
from spanforge.functions import text as fn
from spanforge.model import ATTRIBUTE_DDL, CORPUS_DDL, DOCUMENT_ATTRIBUTE_DDL, DOCUMENT_CORPUS_DDL, DOCUMENT_DDL, SPAN_DDL, Catalog
from spanforge.operators import corpora, lexicon, profile, search, words
from spanforge.plans.compiler import compile_query
from spanforge.sources import files
from spanforge.streaming import incremental

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def catalog(spark):
    docs = [(k, a, t, f"s{k}", "p", None, d, f"{a}-{t}", None, "") for k, a, t, d in ((1, "Catullus", "carmina", -54.0), (2, "Horatius", "odes", -30.0), (3, "Anon", "x", None))]
    spans = [(10 * d + k, d, "tok", k, k, k * 5, 4, "lat", pos, lemma, v, v) for d, ts in {1: [("Dicebat", "VERB", "dico"), ("dicebat", "VERB", "dico"), ("mater", None, "mater"), ("12", None, "12")], 2: [("dicebat", "VERB", "dico"), ("mater", None, None)]}.items() for k, (v, pos, lemma) in enumerate(ts, 1)]
    e = Catalog.empty(spark)
    return replace(
        e,
        document=spark.createDataFrame(docs, DOCUMENT_DDL),
        document_attribute=spark.createDataFrame([(1, "cat", "poetry", 0), (2, "cat", "poetry", 0), (2, "n", "7", 1)], DOCUMENT_ATTRIBUTE_DDL),
        corpus=spark.createDataFrame([("alpha", "A", "", "me"), ("beta", "B", "", None)], CORPUS_DDL),
        document_corpus=spark.createDataFrame([(1, "alpha"), (2, "alpha"), (2, "beta")], DOCUMENT_CORPUS_DDL),
        span=spark.createDataFrame(spans, SPAN_DDL),
        span_attribute=spark.createDataFrame([(11, 1, "x", "1", 0), (13, 1, "foreign", "1", 0)], ATTRIBUTE_DDL),
    )


def ids(df, c="id"):
    return [r[c] for r in df.collect()]


def test_words(catalog):
    w = words.build_words(words.index_tokens(catalog))
    assert {(r["value"], r["pos"], r["count"]) for r in w.collect()} == {("dicebat", "VERB", 3), ("mater", None, 1)}
    assert {(r["value"], r["count"]) for r in words.build_lemmata(w).collect()} == {("dico", 3), ("mater", 1)}
    assigned = {r["id"]: r["word_id"] for r in words.assign_words(catalog.span, w).collect()}
    assert assigned[11] == assigned[12] == assigned[21] and assigned[13] is not None and assigned[14] is None
    assert ids(words.browse(w, "%bat"), "value") == ["dicebat"] == ids(words.browse(w, "d_cebat", min_count=2), "value")
    assert ids(words.browse(w, sort="count", descending=True, page=1, size=1), "value") == ["dicebat"]
    assert ids(words.browse(w, "Mater"), "value") == []
    assert words.index_tokens(catalog, ["VERB"], ["FOREIGN"]).count() == 0
    with pytest.raises(ValueError):
        words.browse(w, sort="pos")


def test_counts(catalog):
    pairs = words.document_pairs(catalog, {"date_value": 3})
    assert {(r["document_id"], r["value"]) for r in pairs.filter("name = 'date_value'").collect()} == {(1, "-54:-46"), (2, "-38:-30")}
    counts = words.count_words(words.index_tokens(catalog), pairs)
    of = {(r["doc_attr_name"], r["doc_attr_value"]): r["count"] for r in counts.join(words.build_words(words.index_tokens(catalog)).filter("value = 'dicebat'").select(F.col("id").alias("word_id")), "word_id").collect()}
    assert of[("author", "Catullus")] == 2 and of[("date_value", "-38:-30")] == 1 and of[("cat", "poetry")] == 3
    one = counts.filter("doc_attr_name = 'cat'").agg(F.max("word_id")).first()[0]
    assert words.token_distribution(counts, "CAT", word=one).count() == 1
    assert words.count_lemmata(counts).filter("doc_attr_name = 'cat'").agg(F.sum("count")).first()[0] == 4
    assert {(r["value"]) for r in words.document_pairs(catalog, {"^date_value": 5}).filter("name = 'date_value'").collect()} == {"-54:-50", "-35:-30"}


def test_bins():
    assert words.bin_edges(0, 10, 5, integer=True) == [(0, 2), (2, 4), (4, 6), (6, 8), (8, 10)]
    assert [round(b, 2) for _, b in words.bin_edges(1.2, 10.7, 3)] == [4.37, 7.53, 10.7]


def test_statistics(catalog):
    s = {r["name"]: r["value"] for r in words.statistics(catalog).collect()}
    assert s["document_count"] == 3 and s["span.tok"] == 6 and s["@x"] == 1 and s["document_attribute_count_ratio"] == 1.0 and s["span_tok_attribute_count_ratio"] == pytest.approx(1 / 3)
    assert s["word_count"] == 0 and s["profile_count"] == 0
    s = {r["name"]: r["value"] for r in words.statistics(words.with_word_index(catalog)).collect()}
    assert s["word_count"] == 2 and s["lemma_count"] == 2 and s["span_count"] == 6


def test_documents(catalog):
    f = corpora.DocumentFilter
    assert ids(corpora.get_documents(catalog, f(author="CAT"))) == [1]
    assert ids(corpora.get_documents(catalog, f(corpus_id="ALPHA", corpus_prefix="al", min_date=-40))) == [2]
    assert ids(corpora.get_documents(catalog, f(attributes=(("n", "7"), ("cat", "POE"))), "date")) == [1, 2]
    assert ids(corpora.get_documents(catalog, f(), page=2, size=2)) == [2]
    assert ids(corpora.get_document(catalog, source="s2")) == [2]
    assert ids(corpora.attribute_names(catalog, "A"), "name") == ["cat"]
    new = catalog.document.filter("id = 1").withColumn("title", F.lit("new"))
    assert sorted(ids(corpora.upsert(catalog.document, new, ("id",)), "title")) == ["new", "odes", "x"]
    assert corpora.add_attribute(catalog, catalog.document_attribute.filter("name = 'n'").withColumn("value", F.lit("8")), unique=True).filter("name = 'n'").first()["value"] == "8"
    gone = corpora.delete_documents(catalog, catalog.document.filter("id = 2"))
    assert gone.span.count() == 4 and gone.document_corpus.count() == 1 and gone.document.count() == 2
    content = corpora.set_content(catalog, catalog.document.filter("id = 1").select("id", F.lit("text").alias("content")))
    assert {r["id"]: r["content"] for r in content.collect()} == {1: "text", 2: "", 3: ""}


def test_corpora(catalog):
    assert [(r["id"], r["n_documents"]) for r in corpora.get_corpora(catalog).collect()] == [("alpha", 2), ("beta", 1)]
    assert corpora.get_corpora(catalog, part="LPH", title="a", user_id="me", with_ids=True).first()["document_ids"] == [1, 2]
    clone = corpora.add_corpus(catalog, "gamma", source="alpha")
    assert sorted(ids(clone.document_corpus.filter("corpus_id = 'gamma'"), "document_id")) == [1, 2]
    assert corpora.delete_corpus(clone, "alpha").document_corpus.count() == 3
    more = corpora.add_documents(catalog, "beta", catalog.document)
    assert more.document_corpus.filter("corpus_id = 'beta'").count() == 3 and more.corpus.count() == 2
    f = corpora.DocumentFilter(author="hor")
    assert corpora.change_by_filter(catalog, "beta", f, add=False).count() == 2
    assert corpora.change_by_filter(catalog, "beta", corpora.DocumentFilter(author="an")).count() == 4
    assert corpora.change_by_filter(catalog, "beta", corpora.DocumentFilter(), add=False).count() == 3
    assert corpora.in_corpus(catalog, 1, "alpha") and not corpora.in_corpus(catalog, 1, "b", prefix=True)
    p = corpora.add_profile(catalog, {"id": "p1", "content": "{}", "type": "t"})
    assert ids(corpora.get_profiles(replace(catalog, profile=p), part="1", prefix="p", kind="t")) == ["p1"]


def test_spans(catalog):
    assert ids(corpora.get_spans(catalog, "tok", [1], 2, 3)) == [12, 13]
    assert ids(corpora.get_spans(catalog, attributes={"X": "1"})) == [11]
    assert ids(corpora.spans_at(catalog, 2, 1, "tok")) == [21]
    added = corpora.add_span_attribute(catalog, 1, 2, 3, "new", "v")
    assert sorted(ids(added.span_attribute.filter("name = 'new'"), "span_id")) == [12, 13]
    assert corpora.delete_span_attributes(added, 1, 3, 9, "new").filter("name = 'new'").count() == 1
    assert corpora.add_span_attribute(catalog, 1, 1, 1, "pos", "N").span.filter("pos = 'N'").count() == 1
    assert corpora.delete_spans(catalog, 1, "tok", others=True).count() == 6 and corpora.delete_spans(catalog, 1).count() == 2


def test_lexicon(spark):
    rows = [(1, "casa", "casa", "casa", "NOUN:gender=fem|number=sing"), (2, "caso", "caso", "caso", "NOUN:gender=masc"), (3, "bello", "bello", "bello", "ADJ"), (4, "bella", "bella", "bello", None), (5, "amare", "amare", "amare", "VERB")]
    lex = spark.createDataFrame(rows, lexicon.LEXICON_DDL)
    assert ids(lexicon.find(lex, "casa")) == [1] and ids(lexicon.find(lex, "CAS", "prefix")) == [1, 2]
    assert ids(lexicon.find(lex, "LLA", "suffix")) == [4] and ids(lexicon.find(lex, "ll", "substring", page=2, size=1)) == [3]
    assert ids(lexicon.find(lex, "csaa", "fuzzy", 0.7)) == [1]
    assert ids(lexicon.find(lex, pos="NOUN:gender=fem")) == [1]
    tag = F.col("pos")
    for q, want in (("NOUN AND gender=masc", [2]), ("NOUN AND (gender=fem OR number!=sing)", [1, 2]), ("ADJ OR VERB", [3, 5])):
        assert sorted(ids(lex.filter(lexicon.tag_query(tag, q)))) == want
    for bad in ("NOUN AND", "(NOUN", "NOUN NOUN", "?"):
        with pytest.raises(ValueError):
            lexicon.tag_query(tag, bad)
    assert lexicon.build_tag(*lexicon.parse_tag("NOUN:b=1|a=2")) == "NOUN:a=2|b=1"
    checked = spark.createDataFrame([("casa", "NOUN"), ("casa", "VERB"), ("amarla", None), ("xyzzy", None), ("ok", None), ("12", "NUM"), ("bell'", None)], "value string, pos string")
    got = {(r["value"], r["pos"]): (r["code"], r["data"]) for r in lexicon.check_words(checked, lex, white=["OK"], skipped_pos=["NUM"]).collect()}
    assert got[("casa", "NOUN")][0] == "ok" and got[("casa", "VERB")][0] == "pos_mismatch" and got[("amarla", None)] == ("var_found", "amare")
    assert got[("xyzzy", None)][0] == "not_found" and got[("ok", None)][0] == "ok" and got[("bell'", None)] == ("var_found", "bello") and ("12", "NUM") not in got
    morph = spark.createDataFrame([("Case", "casa", "NOUN-F:p"), ("è", "essere", "AUX:ind+pres+3+s"), ("?", "?", "SMI")], "form string, lemma string, features string")
    assert sorted(r["pos"] for r in lexicon.convert_morph_list(morph).collect()) == ["AUX:mood=ind|number=sing|person=3|tense=pres", "NOUN:gender=fem|number=plur", "SMI"]


@pytest.mark.parametrize("word,form", [("bellissimo", "bello"), ("dirgli", "dire"), ("far", "fare"), ("dell'", "della"), ("perche'", "perchè"), ("jeri", "ieri"), ("istrada", "strada"), ("(casa)", "casa"), ("perché", "perchè"), ("porgli", "porre"), ("dammi", "da'"), ("andarsene", "andare"), ("intrecciantesi", "intrecciante"), ("tor", "torre"), ("'casa'", "casa"), ("'sto", "sto"), ("cuor", "cuore"), ("pérchè", "pèrché")])
def test_variants(word, form):
    assert form in [f for f, _ in lexicon.italian_variants(word)]


def test_functions(spark):
    row = spark.createDataFrame([(" 5 ", "1d", "12.50", "1848-3-9 x", "Perché l'«Über»?", "chommoda")], "a string, b string, c string, d string, e string, f string")
    got = row.select(
        fn.to_number(F.col("a")), fn.to_number(F.col("b")), fn.to_number(F.col("c")), fn.year_value(F.col("d")), fn.ymd_value(F.col("d")), fn.ymd_value(F.col("d"), unix=True),
        fn.normalise_token(F.col("e")), fn.structure_value(F.col("e")), F.round(fn.trigram_similarity(F.col("f"), "commoda"), 3), fn.normal_length(F.lit("  a \n b ")), fn.osa_similarity(F.col("f"), "chmomoda"),
    ).first()
    assert list(got) == [5.0, None, 12.5, 1848.0, 18480309.0, -3844108800.0, "perchel'uber", "perche l'uber", 0.545, 3, 0.875]
    keys = spark.createDataFrame([("Catullus", "carmina", -54.0), ("Ada Zeta; Bo Alfa", "A b", 1320.0), (None, None, None)], "a string, t string, d double")
    assert [r[0] for r in keys.select(fn.sort_key(F.col("a"), F.col("t"), F.col("d"))).collect()] == ["catullus-carmina-A-0054.00", "alfa-ab-P1320.00", "--P0000.00"]
    assert fn.osa_distance("ca", "abc") == 3 and fn.osa_distance("ab", "ba") == 1 and fn.char_index("ab\ncd", 2, 2) == 4
    assert fn.normalise_literal("''") == "" and fn.normalise_literal("È-l'") == "el'"


def test_tokens(spark):
    docs = spark.createDataFrame([(1, "l'incenso e 100$ o\n100 €.  Fine - ora!"), (2, None), (3, ""), (4, "- ")], "doc_id bigint, text string")
    got = [r["raw"] for r in token_stream(docs, tokenizer="standard", filters=("none",)).orderBy("position").filter("doc_id = 1").collect()]
    assert got == ["l'", "incenso", "e", "100", "$", "o", "100", "€", ".", "Fine", "-", "ora!"]
    rows = full_tokens(docs).orderBy("doc_id", "position").collect()
    text = docs.first()["text"]
    assert all(text[r["index"] : r["index"] + r["length"]] == r["raw"] for r in rows) and {r["doc_id"] for r in rows} == {1}
    assert [(r["value"], r["line"], r["sentence"]) for r in rows][-3:] == [("€", 2, 1), ("fine", 2, 2), ("ora", 2, 2)]
    assert [r["position"] for r in rows] == list(range(1, 9))
    short = [(r["position"], r["value"]) for r in token_stream(docs).filter("doc_id = 1").orderBy("position").collect()]
    assert short == [(r["position"], r["value"]) for r in rows]


XML = """<TEI><teiHeader><title>A &amp; B</title><date when="1320-05-01"/></teiHeader><text><div n="1"><head>Uno</head><lg n="2"><l n="1">Mater abiit. Sic</l><l>dixit <persName>Arrius</persName> mihi</l></lg></div></text></TEI>"""


def test_markup():
    for f in (markup.fill_tags, markup.tei_filter, markup.resolve_entities):
        assert len(f(XML)) == len(XML)
    assert "A &amp; B" not in markup.tei_filter(XML) and "Mater" in markup.tei_filter(XML) and "Arrius" not in markup.fill_tags(XML, ["persname"])
    defs = [markup.StructureDefinition("lg", "div/lg", "{@n}"), markup.StructureDefinition("l", "l[@n='1']", "{text}"), markup.StructureDefinition("x", "persName", "{text}", True, "pn")]
    found = markup.find_structures(XML, defs)
    assert [(f[0], f[3]) for f in found] == [("lg", "2"), ("l", "Mater abiit. Sic"), ("x", "Arrius")]
    assert markup.map_attributes(XML, [markup.AttributeMapping.parse("t=teiHeader/title"), markup.AttributeMapping.parse("y=date/@when [N] ^(\\d{4})"), markup.AttributeMapping.parse("l+=l")]) == [("t", "A & B", 0), ("y", "1320", 1), ("l", "Mater abiit. Sic", 0), ("l", "dixit Arrius mihi", 0)]
    body = markup.fill_tags(XML, ["teiHeader"])
    assert [body[a:b].strip() for a, b in markup.sentences(body, ["head"])] == ["Uno", "Mater abiit.", body[body.index("Sic") : body.index("</l></lg>")]]
    assert [markup.elements("<a><b>x</a>y</b>")[k].path for k in (0, 1)] == ["/a[1]", "/a[1]/b[1]"]
    text = "One two. " * 30
    assert "".join(text[a:b] for a, b in markup.chunks(text, 50)) == text and all(b - a <= 50 for a, b in markup.chunks(text, 50))
    assert markup.chunks("x" * 120, 50) == [(0, 50), (50, 100), (100, 120)]
    tokens = markup.xml_tokens(XML, markup.whitespace_tokens, str.lower)
    assert all(XML[t.index : t.index + t.length] == t.text for t in tokens) and [t.position for t in tokens] == list(range(1, len(tokens) + 1))
    markup.tag_sentences(tokens, lambda ws: [{"upos": "X"} for _ in ws])
    assert all(t.attributes["upos"] == "X" for t in tokens) and sum("s0" in t.attributes for t in tokens) == 2
    assert markup.tagged_value("«Arrius»,", 5, [(0, 9)], str) == "arrius"
    assert markup.tag_ranges(XML, ["head"]) == [("head", XML.index("Uno"), XML.index("Uno") + 3)]


def test_reading():
    root = reading.map_text(XML, [markup.StructureDefinition("lg", "lg", "group {@n}"), markup.StructureDefinition("l", "l")])
    assert [n.label for n in root.visit()] == ["document", "group 2", "l", "l"] and root.descendant("0.0.1").place() == "0.0.1"
    assert reading.parse_map(root.dump()) == root and root.descendant("0.3") is None
    at = XML.index("dixit")
    piece, node = reading.pick_range(XML, root, at, at + 5)
    assert piece == "<l>{{dixit}} <persName>Arrius</persName> mihi</l>" and node.selected
    assert reading.common_ancestor(root.descendant("0.0.0"), root.descendant("0.0.1")).label == "group 2"
    assert reading.highlight("a <b>c</b>", [(0, 6)]) == "<hi>a </hi><b><hi>c</hi></b>"
    r = reading.DocumentReader({1: XML}.get, [markup.StructureDefinition("l", "l")], most=1)
    assert r.read(1, "0.0").startswith("<l n") and r.read(2, "0") is None


def test_profile(spark):
    p = {
        "id": "poems", "text_filters": ["tei"], "attributes": ["len", "punctuation"], "mappings": ["date=date/@when"], "date": {"attribute": "date", "kind": "year"},
        "structures": [{"type": "lg", "path": "lg", "value": "{@n}"}, {"type": "l", "path": "l"}, {"type": "x", "path": "persName", "value": "{text}", "ghost": True, "attribute": "pn"}],
        "sentences": {"stop_tags": ["head"]},
    }
    docs = spark.createDataFrame([(1, "s", XML, "Catullus", "carmina"), (2, "t", None, None, None)], "id bigint, source string, content string, author string, title string")
    c = profile.build(docs, p)
    assert [(r["type"], r["p1"], r["p2"]) for r in c.span.filter("type <> 'tok'").orderBy("type", "p1").collect()] == [("l", 2, 4), ("l", 5, 7), ("lg", 2, 7), ("snt", 1, 1), ("snt", 2, 3), ("snt", 4, 7)]
    assert [r["value"] for r in compile_query(c, '[pn="Arrius"]').collect()] == ["arrius"]
    assert [r["value"] for r in compile_query(c, '[value$="t"] AND [rp] INSIDE() [$lg]').collect()] == ["abiit"]
    assert {r["id"]: r["date_value"] for r in c.document.collect()} == {1: 1320.0, 2: None}
    with pytest.raises(ValueError):
        profile.build(docs, {"token_filters": ["nothing"]})


def test_profile_tokenizers(spark):
    docs = spark.createDataFrame([(1, "s", "l'incenso 100$ x\n<b>Rossi's,</b> due &amp; tre."), (2, "t", "A<b>c</b>d")], "id bigint, source string, content string")

    def tokens(p, of=1):
        c = profile.build(docs, p)
        return c, [(r["value"], r["index"]) for r in c.span.filter(f"type = 'tok' and document_id = {of}").orderBy("p1").collect()]

    text = docs.first()["content"]
    _, got = tokens({"tokenizer": "standard"})
    assert [v for v, _ in got][:5] == ["l'", "incenso", "100", "$", "x"] and all(text[i].lower() == v[0] or not text[i].isalnum() for v, i in got)
    assert [v for v, _ in tokens({"token_filters": []})[1]][:2] == ["l'incenso", "100$"]
    assert [v for v, _ in tokens({"tokenizer": "xml"}, 2)[1]] == ["a", "c", "d"] and ("rossi's", text.index("Rossi")) in tokens({"tokenizer": "xml"})[1]
    c, got = tokens({"tokenizer": "xml", "protected_tags": ["b"], "attributes": ["letters"]})
    assert ("rossi's", text.index("Rossi")) in got and c.span_attribute.filter("name = 'letters'").count() == len(got) + 3
    for bad in ({"tokenizer": "none"}, {"text_filters": ["none"]}):
        with pytest.raises(ValueError):
            profile.build(docs, bad)
    replaced = profile.build(docs, {"text_filters": [{"replace": [["due", "duo", False, 1]]}]})
    assert replaced.span.filter("value = 'duo'").count() == 1


def test_profile_tagging_and_structures(spark):
    docs = spark.createDataFrame([(1, "s", XML), (2, "t", XML.replace("1320", "1400"))], "id bigint, source string, content string")
    p = {"text_filters": ["tei"], "mappings": ["date=date/@when ^(\\d{4})"], "tagging": {"stop_tags": ["head"], "most": 2}, "structure_filter": True, "structure_documents": {"DATE": "1320"}}
    p["structures"] = [{"type": "l", "path": "l", "value": "{text}"}, {"type": "x", "path": "persName", "value": "PROPN", "ghost": True, "attribute": "pos"}]
    c = profile.build(docs, p, tagger=lambda ws: [{"upos": w[:1], "pos": "X", "lemma": w.lower() + "_"} for w in ws])
    spans = c.span.filter("document_id = 1").orderBy("type", "p1").collect()
    assert [(r["type"], r["value"]) for r in spans if r["type"] == "l"] == [("l", "mater abiit sic"), ("l", "dixit arrius mihi")]
    assert {r["value"]: (r["pos"], r["lemma"]) for r in spans if r["type"] == "tok"}["arrius"] == ("PROPN", "arrius_") and spans[2]["pos"] == "X"
    assert c.span.filter("document_id = 2 and type = 'l'").count() == 0
    assert [r["p1"] for r in c.span.join(c.span_attribute.filter("name = 's0'").select(F.col("span_id").alias("id")), "id").filter("document_id = 1").orderBy("p1").collect()] == [1, 2, 4, 6]


def test_tagger(spark):
    text = "Vado della casa di Benedetta ecc. ,"
    conllu = "\n".join(
        "\t".join(x)
        for x in [
            ("1", "Vado", "andare", "VERB", "V", "Mood=Ind|Number=Sing", "0", "root", "_", "TokenRange=0:4"), ("2-3", "della", "_", "_", "_", "_", "_", "_", "_", "TokenRange=5:10"),
            ("2", "di", "di", "ADP", "E", "_", "4", "case", "_", "_"), ("3", "la", "il", "DET", "RD", "Gender=Fem|Number=Sing", "4", "det", "_", "_"),
            ("4", "casa", "casa", "NOUN", "S", "Gender=Fem", "1", "obl", "_", "TokenRange=11:15"), ("6", "Benedetta", "benedetto", "ADJ", "A", "_", "4", "amod", "_", "TokenRange=19:28"),
            ("7", "ecc.", "ecc", "NOUN", "S", "_", "4", "x", "_", "TokenRange=29:33"), ("8", ",", ",", "PUNCT", "F", "_", "4", "punct", "_", "TokenRange=34:35"),
        ]
    )
    rows = tagged.parse_conllu("# x\n" + conllu)
    assert len(rows) == 6 and [c["upos"] for c in rows[1]["children"]] == ["ADP", "DET"]
    names = [c.split(" ")[0] for c in tagged.TAGGED_DDL.split(", ")]
    found = spark.createDataFrame([tuple({"document_id": 1, **r}[n] for n in names) for r in rows], tagged.TAGGED_DDL)
    spans = [(k, 1, "tok", k, k, text.index(w), len(w), None, "PROPN" if w == "Benedetta" else None, None, w.lower(), w) for k, w in enumerate(text.split(), 1)]
    spans = spark.createDataFrame(spans, SPAN_DDL)
    rule = {"min": 2, "max": 2, "tokens": [{"upos": "ADP"}, {"upos": "ADV", "optional": True}, {"upos": "DET", "feats": {"Number": "Sing"}}], "target": {"upos": "ADP", "xpos": "EA", "feats": {"*": "2", "Case": "Gen", "Number": "2"}}}
    over = spark.createDataFrame([(1, text.index("ecc"), 3, "X", None, {"Abbr": "Yes"})], "document_id bigint, index int, length int, upos string, xpos string, feats map<string,string>")
    out, attributes = tagged.apply_tagger(spans, found, preserved=["PROPN"], multiwords=[rule], overrides=over, extended_pos=True, prefix="u_")
    got = {r["value"]: (r["pos"], r["lemma"]) for r in out.collect()}
    assert got["vado"] == ("VERB.V", "andare") and got["della"] == ("ADP.EA", "della") and got["casa"] == ("NOUN.S", "casa")
    assert got["benedetta"] == ("PROPN", None) and got["ecc."] == ("X.S", "ecc") and got[","] == (None, None) and got["di"] == (None, None)
    of = {}
    for r in attributes.collect():
        of.setdefault(r["span_id"], {})[r["name"]] = r["value"]
    assert of[2] == {"u_xpos": "EA", "u_gender": "fem", "u_number": "sing", "u_case": "gen"} and of[1]["u_mood"] == "ind" and of[1]["u_head"] == "0" and of[6]["u_abbr"] == "yes" and 5 not in of
    assert tagged.child_rule([{"upos": "DET"}], [rule]) is None


def test_files(spark, catalog, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.txt").write_text("uno due\ntre")
    (tmp_path / "in" / "a.txt").write_text("quattro")
    (tmp_path / "in" / "a.csv").write_text("name,value\ndate#,12\ncat, x \n")
    base = f"{tmp_path}/in"
    assert [os.path.basename(x) for x in ids(files.collect_files(spark, base, "*.txt"), "source")] == ["a.txt", "b.txt"]
    texts = files.read_texts(spark, base, "*.txt", find=r"^.*/")
    texts = {r["source"]: r["content"] for r in texts.collect()}
    assert texts == {"a.txt": "quattro", "b.txt": "uno due\ntre"}
    attrs = files.read_csv_attributes(spark, base, names={"cat": "category"})
    assert {(os.path.basename(r["source"]), r["name"], r["value"], r["type"]) for r in attrs.collect()} == {("a.txt", "date", "12", 1), ("a.txt", "category", "x", 0)}
    catalog.write(f"{tmp_path}/cat")
    again = Catalog.read(spark, f"{tmp_path}/cat")
    assert again.span.count() == 6 and again.corpus.count() == 2
    files.write_token_cache(catalog.span, catalog.span_attribute, f"{tmp_path}/cache")
    assert {(r["document_id"], r["position"], r["name"]) for r in files.read_token_cache(spark, f"{tmp_path}/cache").collect()} == {(1, 1, "x"), (1, 3, "foreign")}
    files.dump_spans(catalog, f"{tmp_path}/dump", document_id=1)
    assert spark.read.option("header", True).csv(f"{tmp_path}/dump").filter("at_n is not null").count() == 2
    files.write_tagger_input(catalog.span, f"{tmp_path}/tagger")
    assert spark.read.option("sep", "\t").csv(f"{tmp_path}/tagger").count() == 6


def test_stream(spark, tmp_path):
    folder, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    os.makedirs(folder)
    open(f"{folder}/a.txt", "w").write("uno due")
    open(f"{folder}/b.txt", "w").write("tre")
    incremental.start_indexing(spark, folder, out, state, buckets=4).awaitTermination()
    assert sorted(ids(spark.read.parquet(out), "value")) == ["due", "tre", "uno"]
    open(f"{folder}/c.txt", "w").write("quattro")
    incremental.start_indexing(spark, folder, out, state, buckets=4).awaitTermination()
    assert sorted(ids(spark.read.parquet(out), "value")) == ["due", "quattro", "tre", "uno"]
    source = spark.read.parquet(out).filter("value = 'tre'").first()["source"]
    changed = spark.createDataFrame([(source, "cinque sei")], "source string, content string")
    for _ in range(2):
        incremental.merge_batch(spark, changed, out, 4)
        spark.catalog.refreshByPath(out)
        assert sorted(ids(spark.read.parquet(out), "value")) == ["cinque", "due", "quattro", "sei", "uno"]


def test_emptied_documents(spark, tmp_path):
    """A document that is alone in its bucket loses all its tokens."""
    out = f"{tmp_path}/out"

    def merge(*rows):
        incremental.merge_batch(spark, spark.createDataFrame(rows, "source string, content string"), out, 64)
        spark.catalog.refreshByPath(out)
        return sorted(ids(spark.read.schema("value string, bucket int").parquet(out), "value")) if os.path.exists(out) else []

    assert merge(("a", "uno due"), ("b", "tre")) == ["due", "tre", "uno"]
    assert merge(("a", " - ")) == ["tre"] and merge(("a", ""), ("b", None)) == [] and merge(("b", "quattro")) == ["quattro"]


def test_ids_of_any_document(spark):
    """Documents numbered by hashes: spans have ids of their own, and positional queries and contexts work."""
    big = [2**62, 2**62 + 1, -(2**63), 5, 9_000_000_001]
    docs = spark.createDataFrame([(d, "s", "the house of the lord. the end") for d in big], "id bigint, source string, content string")
    c = profile.build(docs, {"sentences": {}, "attributes": ["len"]})
    assert c.span.select("id").distinct().count() == c.span.count() == len(big) * 9
    found = compile_query(c, '[value="the"] BEFORE(m=1) [value="of"]')
    assert sorted(ids(found, "document_id")) == sorted(big)
    assert {tuple(r["left"] + r["right"]) for r in search.kwic(found, c, 2).collect()} == {("", "", "house", "of")}
    assert compile_query(c, '[value="the"] AND [len=="3"] INSIDE() [$snt]').count() == 3 * len(big)


def test_batch_export(spark, catalog, tmp_path):
    done = search.export_batch(catalog, "dicebat\n\n[value=\"mater\"]\n\n@[author=\"Anon\"]; [value=\"x\"]\n", f"{tmp_path}/out", context=1)
    assert [q for q, _ in done] == ['[value="dicebat"]', '[value="mater"]', '@[author="Anon"]; [value="x"]']
    read = [[r.asDict() for r in spark.read.option("header", True).csv(p).collect()] for _, p in done]
    assert [len(r) for r in read] == [3, 2, 0] and {r["c1"] for r in read[0]} == {"dicebat", "mater"} and {r["author"] for r in read[1]} == {"Catullus", "Horatius"}
    search.export_kwic(catalog, '[value="dicebat"]', f"{tmp_path}/page", 1, first_page=2, last_page=2, size=2)
    assert spark.read.option("header", True).csv(f"{tmp_path}/page").count() == 1


def test_check_spans(spark, catalog):
    lex = spark.createDataFrame([(1, "mater", "mater", "mater", None)], lexicon.LEXICON_DDL)
    plain = replace(catalog, span=catalog.span.withColumn("language", F.lit(None).cast("string")))
    got = {r["id"]: (r["code"], r["context"]) for r in lexicon.check_spans(plain, lex, alphabetic=True, excluded_attributes={"X": "1"}, context=1).collect()}
    assert got == {12: ("not_found", "Dicebat [dicebat] mater"), 21: ("not_found", "[dicebat] mater")}
    assert lexicon.check_spans(plain, lex, excluded_pos=["VERB"], context=0).first()["context"] == "12"
    assert lexicon.check_spans(catalog, lex).count() == 0


def test_workers_get_the_code(tmp_path):
    """Workers that start elsewhere than in the repository."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    program = f"""
import sys
sys.path.append({root!r})
from pyspark.sql import SparkSession, functions as F
from spanforge.analysis import markup
from spanforge.operators import lexicon, profile
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).config("spark.sql.shuffle.partitions", 2).getOrCreate()
lex = spark.createDataFrame([(1, "nation", "nation", "nation", "X")], lexicon.LEXICON_DDL)
print("FOUND", lexicon.find(lex, "natoin", "fuzzy", 0.7).count())
docs = spark.createDataFrame([(1, "s", "<p>One <b>two</b></p>")], "id bigint, source string, content string")
print("FOUND", markup.structures(docs, [markup.StructureDefinition("b", "b")], "id", "content").count())
print("FOUND", profile.build(docs, {{"text_filters": ["tags"], "structures": [{{"type": "b", "path": "b"}}]}}).span.count())
spark.stop()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_SCALA_VERSION": "2.13"}
    run = subprocess.run([sys.executable, "-c", program], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=280)
    assert [x.split()[1] for x in run.stdout.splitlines() if x.startswith("FOUND")] == ["1", "1", "3"], run.stderr[-2000:]


@pytest.mark.parametrize("name", ["tok_offsets", "struct_snt", "pair_fuzzy", "scope_doc_open", "loc_not_near", "loc_shared_structure", "kwic", "lemma_counts", "statistics", "search_sort_attribute", "doc_bins", "index_spans", "char_ranges", "lookup_join", "lookup_fuzzy", "tag_filter", "token_distribution"])
def test_against_sql(spark, name):
    if not os.path.exists(DATA):
        pytest.skip("no test data")
    got = entry.queries()[name](spark, DATA).toPandas()
    assert len(got) and compare(got, connect(DATA).execute(entry.oracle_sql()[name]).fetchdf()) == ""


def test_entry(spark):
    if os.path.exists(DATA):
        assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
