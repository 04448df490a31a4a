"""The corpus model's own stores: lossless JSON, records, SQLite.

``documents``: doc_id, doc_order, script_id, site, support, scribe, findspot, period, name, translations.
``tokens``: doc_id, doc_order, token_order, position, line_no, text, kind, status, signs, alt, annotations."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulae.functions.numerals import parse_value

META = ["site", "support", "scribe", "findspot", "period", "name"]
SCHEMA_VERSION = 3
_TOKEN = "struct<text:string,kind:string,status:string,line_no:int,position:int,signs:array<string>,alt:array<string>,annotations:map<string,string>>"
_DOCUMENT = f"struct<id:string,script_id:string,meta:struct<{','.join(f'{m}:string' for m in META)}>,translations:array<string>,tokens:array<{_TOKEN}>>"
CORPUS = f"_meta struct<schemaVersion:int,scriptId:string>, provenance map<string,string>, documents array<{_DOCUMENT}>"
RECORD = f"id string, lines array<array<string>>, words array<string>, text string, meta struct<{','.join(f'{m}:string' for m in META)}>, translations array<string>"
DOCUMENTS = f"doc_order long, doc_id string, script_id string, {', '.join(f'{m} string' for m in META)}, translations array<string>"
TOKENS = "doc_id string, doc_order long, token_order int, position int, line_no int, text string, kind string, status string, signs array<string>, alt array<string>, annotations map<string,string>"


def _unfold(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents and tokens of rows (doc_order, d)."""
    documents = rows.select("doc_order", F.col("d.id").alias("doc_id"), F.col("d.script_id").alias("script_id"), *[F.coalesce(f"d.meta.{m}", F.lit("")).alias(m) for m in META], F.coalesce("d.translations", F.array().cast("array<string>")).alias("translations"))
    tokens = rows.select(F.col("d.id").alias("doc_id"), "doc_order", F.posexplode("d.tokens").alias("token_order", "t")).select("doc_id", "doc_order", "token_order", "t.position", "t.line_no", "t.text", "t.kind", F.coalesce("t.status", F.lit("certain")).alias("status"), F.coalesce("t.signs", F.array().cast("array<string>")).alias("signs"), F.coalesce("t.alt", F.array().cast("array<string>")).alias("alt"), F.coalesce("t.annotations", F.create_map().cast("map<string,string>")).alias("annotations"))
    return documents, tokens


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """documents and tokens of corpus files: one object each with ``documents``. A file of a
    newer schema version is refused."""
    rows = spark.read.schema(CORPUS).json(path, multiLine=True)
    newest = rows.agg(F.max("_meta.schemaVersion")).first()[0]
    if newest is not None and newest > SCHEMA_VERSION:
        raise ValueError(f"schema version {newest} is newer than {SCHEMA_VERSION}")
    return _unfold(rows.select(F.posexplode("documents").alias("doc_order", "d")).withColumn("doc_order", F.col("doc_order").cast("long")))


def folded(documents: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_order, d): each document with its tokens in order, as in a corpus file. A document's
    tokens are gathered, never those of several."""
    token = F.struct("token_order", F.struct("text", "kind", "status", "line_no", "position", "signs", "alt", "annotations").alias("t"))
    held = tokens.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(token), lambda a, b: a["token_order"] - b["token_order"]), lambda x: x["t"]).alias("tokens"))
    return documents.join(held, "doc_id", "left").select("doc_order", F.struct(F.col("doc_id").alias("id"), "script_id", F.struct(*META).alias("meta"), "translations", F.coalesce("tokens", F.array().cast(f"array<{_TOKEN}>")).alias("tokens")).alias("d"))


def write_json(documents: DataFrame, tokens: DataFrame, path: str, script_id: str = "", provenance: dict | None = None) -> None:
    """One corpus file below ``path``, a line a document: rows stream through one writer in order."""
    head = json.dumps({"_meta": {"schemaVersion": SCHEMA_VERSION, "scriptId": script_id}, "provenance": provenance or {}}, ensure_ascii=False)[:-1] + ', "documents": ['
    rows = folded(documents, tokens).select("doc_order", F.to_json("d").alias("value"))
    first = rows.agg(F.min("doc_order")).first()[0]
    rows = rows.withColumn("value", F.when(F.col("doc_order") == first, F.col("value")).otherwise(F.concat(F.lit(","), "value")))
    spark = documents.sparkSession
    ends = spark.createDataFrame([(-1 << 62, head), (1 << 62, "]}")], "doc_order long, value string")
    ends.unionByName(rows).coalesce(1).sortWithinPartitions("doc_order").select("value").write.mode("overwrite").text(path)


def from_records(records: DataFrame, script_id: str = "custom") -> tuple[DataFrame, DataFrame]:
    """documents and tokens of records (``RECORD``, and doc_order): lines, else words, else text. A
    token is a text, or an object with text and, if need be, kind, status and alternatives; without a
    kind it is a numeral if it states a number, else a word. A record without an id or any
    text, and a kind or status that isn't known, end the query with an error."""
    words = F.when(F.col("text").isNotNull(), F.filter(F.split("text", "\\s+"), lambda x: x != ""))
    lines = F.coalesce("lines", F.when(F.col("words").isNotNull(), F.array("words")), F.when(words.isNotNull(), F.array(words)))
    checked = F.when(F.col("id").isNull(), F.raise_error("record without an id").cast("array<array<string>>")).when(lines.isNull(), F.raise_error(F.concat(F.lit("record needs lines, words or text: "), "id")).cast("array<array<string>>")).otherwise(lines)
    rows = records.select("doc_order", F.col("id"), "meta", "translations", checked.alias("ls"))
    documents = rows.select("doc_order", F.col("id").alias("doc_id"), F.lit(script_id).alias("script_id"), *[F.coalesce(f"meta.{m}", F.lit("")).alias(m) for m in META], F.coalesce("translations", F.array().cast("array<string>")).alias("translations"))
    numbered = F.flatten(F.transform("ls", lambda line, k: F.transform(line, lambda x: F.struct(k.alias("line_no"), x.alias("raw")))))
    t = rows.select(F.col("id").alias("doc_id"), "doc_order", F.posexplode(numbered).alias("token_order", "x"))
    spec = F.when(F.col("x.raw").startswith('{"'), F.from_json("x.raw", "text string, kind string, status string, alt array<string>"))
    t = t.select("doc_id", "doc_order", "token_order", F.col("token_order").alias("position"), "x.line_no", "x.raw", spec.alias("s"))
    text = F.coalesce("s.text", "raw")
    kind = F.coalesce("s.kind", F.when(parse_value(text).isNotNull(), "numeral").otherwise("word"))
    known = lambda c, names: F.when(c.isin(names), c).otherwise(F.raise_error(F.concat(F.lit("unknown kind or status: "), c)).cast("string"))
    tokens = t.select(
        "doc_id", "doc_order", "token_order", "position", "line_no", text.alias("text"), known(kind, ["word", "logogram", "numeral", "separator", "punct", "unknown"]).alias("kind"),
        known(F.coalesce("s.status", F.lit("certain")), ["certain", "unclear", "restored", "lost"]).alias("status"), F.when(text.contains("-"), F.split(text, "-")).otherwise(F.array().cast("array<string>")).alias("signs"),
        F.coalesce("s.alt", F.array().cast("array<string>")).alias("alt"), F.create_map().cast("map<string,string>").alias("annotations"),
    )
    return documents, tokens


_TABLES = f"CREATE TABLE IF NOT EXISTS meta (key TEXT PRIMARY KEY, value TEXT); CREATE TABLE IF NOT EXISTS documents (doc_order INTEGER, id TEXT PRIMARY KEY, script_id TEXT, {', '.join(f'{m} TEXT' for m in META)}, translations TEXT); CREATE TABLE IF NOT EXISTS tokens (doc_id TEXT, token_order INTEGER, position INTEGER, line_no INTEGER, text TEXT, kind TEXT, status TEXT, signs TEXT, alt TEXT, annotations TEXT); CREATE INDEX IF NOT EXISTS tokens_by_doc ON tokens (doc_id); CREATE INDEX IF NOT EXISTS tokens_by_text ON tokens (text);"


def write_sqlite(documents: DataFrame, tokens: DataFrame, path: str, append: bool = False) -> None:
    """One SQLite file, a single writer by its nature: rows stream to the driver a partition at a
    time. With ``append`` documents of the same id are replaced and others added behind."""
    dumped = lambda x: json.dumps(x, ensure_ascii=False)
    with sqlite3.connect(path) as con:
        if not append:
            con.executescript("DROP TABLE IF EXISTS meta; DROP TABLE IF EXISTS documents; DROP TABLE IF EXISTS tokens;")
        con.executescript(_TABLES)
        con.execute("INSERT OR REPLACE INTO meta VALUES ('schema_version', ?)", (str(SCHEMA_VERSION),))
        start = con.execute("SELECT coalesce(max(doc_order) + 1, 0) FROM documents").fetchone()[0]
        for r in documents.orderBy("doc_order").toLocalIterator():
            con.execute("DELETE FROM tokens WHERE doc_id = ?", (r.doc_id,))
            old = con.execute("SELECT doc_order FROM documents WHERE id = ?", (r.doc_id,)).fetchone()
            con.execute(f"INSERT OR REPLACE INTO documents VALUES ({', '.join('?' * (len(META) + 4))})", (old[0] if old else start, r.doc_id, r.script_id, *(r[m] for m in META), dumped(r.translations)))
            start += old is None
        con.executemany("INSERT INTO tokens VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?, ?)", ((r.doc_id, r.token_order, r.position, r.line_no, r.text, r.kind, r.status, dumped(r.signs), dumped(r.alt), dumped(r.annotations)) for r in tokens.toLocalIterator()))


def read_sqlite(spark: SparkSession, path: str, slices: int = 8) -> tuple[DataFrame, DataFrame]:
    """documents and tokens of a SQLite file that all executors see: each task reads a range of
    documents by its own connection. ``documents`` alone is the stream of documents."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        found = con.execute("SELECT value FROM meta WHERE key = 'schema_version'").fetchone()
        if found and int(found[0]) > SCHEMA_VERSION:
            raise ValueError(f"schema version {found[0]} is newer than {SCHEMA_VERSION}")
        last = con.execute("SELECT coalesce(max(doc_order), -1) FROM documents").fetchone()[0]
    step = max(1, -(-(last + 1) // slices))
    ranges = spark.range(0, last + 1, step).repartition(slices).select(F.col("id").alias("lo"), (F.col("id") + step).alias("hi"))

    def reader(sql: str, names: list[str], lists: list[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for lo, hi in zip(b["lo"], b["hi"]):
                    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
                        cursor = con.execute(sql, (int(lo), int(hi)))
                        while rows := cursor.fetchmany(10_000):
                            out = pd.DataFrame(rows, columns=names)
                            for c in lists:
                                out[c] = out[c].map(json.loads)
                            yield out

        return run

    documents = ranges.mapInPandas(reader(f"SELECT doc_order, id, script_id, {', '.join(META)}, translations FROM documents WHERE doc_order >= ? AND doc_order < ?", ["doc_order", "doc_id", "script_id", *META, "translations"], ["translations"]), DOCUMENTS)
    names = ["doc_id", "doc_order", "token_order", "position", "line_no", "text", "kind", "status", "signs", "alt", "annotations"]
    tokens = ranges.mapInPandas(reader("SELECT t.doc_id, d.doc_order, token_order, position, line_no, text, kind, status, signs, alt, annotations FROM documents d JOIN tokens t ON t.doc_id = d.id WHERE doc_order >= ? AND doc_order < ?", names, ["signs", "alt", "annotations"]), TOKENS)
    return documents, tokens
