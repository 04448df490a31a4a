"""Stores of the corpus model: what is written is what is read."""

import json
import sqlite3
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from tabulae.operators import corpus as ops
from tabulae.operators.query import Condition, merge, query, summarize
from tabulae.sources import corpus, readers

RECORDS = [
    {"id": "a 1", "lines": [["KU-RO", {"text": "10", "kind": "word", "status": "unclear", "alt": ["KU-RA"]}], ["¾"]], "meta": {"site": " Haghia  Triada "}},
    {"id": "b", "words": ["te", "3/4"], "translations": ["x"]},
    {"id": "c.2", "text": "some words 12"},
]


def records(spark, tmp_path, rows=RECORDS):
    path = tmp_path / "records.jsonl"
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
    df = spark.read.schema(corpus.RECORD).json(str(path))
    return corpus.from_records(df.withColumn("doc_order", F.monotonically_increasing_id()))


def content(documents, tokens):
    key = lambda rows: sorted((r.asDict(recursive=True) for r in rows), key=str)
    return key(documents.collect()), key(tokens.select(*sorted(tokens.columns)).collect())


def test_records(spark, tmp_path):
    documents, tokens = records(spark, tmp_path)
    got = [(r.doc_id, r.text, r.kind, r.status, r.line_no, list(r.signs), list(r.alt)) for r in tokens.orderBy("doc_order", "token_order").collect()]
    assert got[:3] == [("a 1", "KU-RO", "word", "certain", 0, ["KU", "RO"], []), ("a 1", "10", "word", "unclear", 0, [], ["KU-RA"]), ("a 1", "¾", "numeral", "certain", 1, [], [])]
    assert [g[2] for g in got[3:]] == ["word", "numeral", "word", "word", "numeral"]
    assert ops.apparatus_summary(tokens).first().asDict() == {"documents": 3, "tokens": 8, "certain": 7, "unclear": 1, "restored": 0, "lost": 0, "documents_with_apparatus": 1, "alt": 1}
    assert {tuple(r.tokens) for r in ops.line_tokens(tokens).collect()} >= {("KU-RO", "10"), ("¾",)}


@pytest.mark.parametrize("bad", [{"words": ["x"]}, {"id": "x"}, {"id": "x", "words": [{"text": "t", "kind": "odd"}]}])
def test_bad_records_are_errors(spark, tmp_path, bad):
    with pytest.raises(Exception, match="record|unknown kind"):
        _, tokens = records(spark, tmp_path, [bad])
        tokens.collect()


def test_json_and_sqlite_round_trips(spark, tmp_path):
    documents, tokens = records(spark, tmp_path)
    corpus.write_json(documents, tokens, str(tmp_path / "json"), "lineara", {"source": "here"})
    again = corpus.read_json(spark, str(tmp_path / "json"))
    want = content(documents.drop("doc_order"), tokens.drop("doc_order"))
    assert content(again[0].drop("doc_order"), again[1].drop("doc_order")) == want
    path = str(tmp_path / "corpus.db")
    corpus.write_sqlite(documents, tokens, path)
    back = corpus.read_sqlite(spark, path, 2)
    assert content(back[0].drop("doc_order"), back[1].drop("doc_order")) == want
    corpus.write_sqlite(documents.filter("doc_id = 'b'").withColumn("site", F.lit("new")), tokens.filter("doc_id = 'b'"), path, append=True)
    got = [(r.doc_id, r.site) for r in corpus.read_sqlite(spark, path)[0].orderBy("doc_order").collect()]
    assert [g[0] for g in got] == ["a 1", "b", "c.2"] and got[1][1] == "new"
    with sqlite3.connect(path) as con:
        con.execute("UPDATE meta SET value = '9'")
    with pytest.raises(ValueError):
        corpus.read_sqlite(spark, path)


def test_ids_as_people_write_them(spark):
    ids = ["HT 13", "x:HT 14", "PY.Ta 1", "HT 15", "ht 15", "y:dup", "z:dup"]
    documents = spark.createDataFrame([(i,) for i in ids], "doc_id string")
    find = lambda x: [r.doc_id for r in ops.resolve_document(documents, x).collect()]
    assert (find("HT 13"), find("HT 14"), find("ht13"), find("pyta1"), find("HT 15"), find("Ht15"), find("dup"), find("no")) == (["HT 13"], ["x:HT 14"], ["HT 13"], ["PY.Ta 1"], ["HT 15"], [], [], [])
    assert [r.doc_id for r in ops.resolve_documents(documents, "HT 13-15").orderBy("_place").collect()] == ["HT 13", "x:HT 14", "HT 15"]
    assert [r.doc_id for r in ops.near_ids(documents, "ht1").collect()] == ["HT 13", "HT 15", "ht 15", "x:HT 14"] and ops.suggest("LineraA", ["lineara", "linearb"])[0] == "lineara"
    with pytest.raises(ValueError):
        ops.filter_documents(documents, nothing=1)


def test_review_flags_and_alignment(spark):
    rows = [({"review_recommended": "True"}, True), ({"review_recommended": "x", "lemma_source": "identity"}, True), ({"lemma_source": "rule", "lemma_known": "false"}, False), ({"lemma_known": "false"}, True), ({}, False)]
    df = spark.createDataFrame(rows, "a map<string,string>, want boolean")
    assert df.filter(ops.needs_review_flag(F.col("a")) != F.col("want")).count() == 0
    docs = spark.createDataFrame([("d", "ab cd")], "doc_id string, source_text string")
    spans = spark.createDataFrame([("d", 0, 2, "ab"), ("d", 3, 5, "cx")], "doc_id string, start int, stop int, original string")
    assert [r.original for r in ops.misaligned(spans, docs).collect()] == ["cx"]


def test_merge_policies(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    with pytest.raises(Exception, match="more than once"):
        merge([t, t], "id").collect()
    with pytest.raises(ValueError):
        merge([t], "id", "other")
    assert sorted(map(tuple, merge([t, t.withColumn("v", F.col("v") + 5)], "id", "last").collect())) == [("a", 6), ("b", 7)] and merge([t], "id").count() == 2


def test_cooccurrence_is_corpus_wide(spark):
    t = spark.createDataFrame([(1, "x", "te"), (1, "x", "lo"), (2, "y", "lo"), (2, "y", "ka")], "doc_id int, site string, text string")
    got = query(t, [Condition("site-is", "y"), Condition("word-cooccurs-with", "te")], "words").collect()
    assert [(r.text, r.docs) for r in got] == [("lo", 1)]
    assert summarize([Condition("site-is", ""), Condition("has-image", True, negate=True)]) == "Site is: (any) · NOT Has facsimile image: yes"


def test_conllu_keeps_every_line(spark, tmp_path):
    line = "\t".join(["1", "μῆνιν", "_", "NOUN", "_", "_", "0", "root", "_", "_"])
    text = f"# newdoc\n# sent_id = s1\n{line}\n\n{line}\n\n{line}\n1.1\tx\t_\t_\t_\t_\t_\t_\t_\t_\n\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.conllu").write_text(text)
    rows = readers.read_conllu(spark, str(tmp_path / "in"), strict=True)
    assert rows.filter("comment IS NULL").count() == 4 and rows.select("block").distinct().count() == 3
    readers.write_conllu(rows, str(tmp_path / "out"))
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part*")) == text
    (tmp_path / "in" / "b.conllu").write_text("1\tx\n")
    with pytest.raises(Exception, match="ten cells"):
        readers.read_conllu(spark, str(tmp_path / "in"), strict=True).collect()


def test_text_files_and_graphs(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_text("same\r\nsame\n\n other \n")
    assert sorted(map(tuple, readers.from_text(spark, str(tmp_path / "t")).collect())) == [("x.txt#0", "same"), ("x.txt#1", "same"), ("x.txt#2", "other")]
    assert sorted(map(tuple, readers.from_text(spark, str(tmp_path / "t"), "paragraph").collect())) == [("x.txt#0", "same\nsame"), ("x.txt#1", "other")]
    edges = spark.createDataFrame([("a<", "b&", 2), ("a<", "c", 1)], "source string, target string, weight int")
    for form in ("gexf", "graphml"):
        readers.write_graph(edges, str(tmp_path / form), form)
        root = ET.fromstring("".join(p.read_text() for p in (tmp_path / form).glob("part*")))
        tags = [e.tag.rpartition("}")[2] for e in root.iter()]
        assert tags.count("node") == 3 and tags.count("edge") == 2
    docs = spark.createDataFrame([("a 1", 'say "x"', "")], "doc_id string, name string, site string")
    readers.write_rdf(docs, str(tmp_path / "rdf"), "http://example.org/", ["name", "site"])
    lines = sorted("".join(p.read_text() for p in (tmp_path / "rdf").glob("part*")).splitlines())
    assert len(lines) == 3 and lines[1] == '<http://example.org/a+1> <http://example.org/name> "say \\"x\\"" .'
