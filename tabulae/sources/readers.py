"""Sources and sinks of the corpus model: a wire form in JSON lines, text, tables, CoNLL-U, graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

def from_text(spark: SparkSession, path: str, split: str = "line") -> DataFrame:
    """(doc_id, text): one document a file, paragraph or line of text files. Ids are the file's name
    and the number of the paragraph or line that isn't empty, so equal lines keep theirs."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))
    if split == "whole":
        return files.select(F.col("file").alias("doc_id"), "text")
    parts = F.filter(F.transform(F.split("text", "\n\\s*\n" if split == "paragraph" else "\n"), lambda x: F.regexp_replace(x, "^\\s+|\\s+$", "")), lambda x: x != "")
    return files.select("file", F.posexplode(parts).alias("k", "text")).select(F.concat("file", F.lit("#"), F.col("k").cast("string")).alias("doc_id"), "text")


def read_tabular(spark: SparkSession, path: str, schema: str | T.StructType, format: str = "csv") -> DataFrame:
    """CSV, JSON, Parquet or ORC with a given schema, so columns and filters reach the scan."""
    reader = spark.read.schema(schema)
    return reader.csv(path, header=True) if format == "csv" else reader.format(format).load(path)


def write_tabular(df: DataFrame, path: str, format: str = "parquet", partition: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").format(format)
    if format == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition) if partition else writer).save(path)


CONLLU = ["token_id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc"]


def read_conllu(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """One row a line of CoNLL-U, none lost: (file, block, sent_id, order, comment) and the ten cells
    as they stand; a comment has no cells. A sentence is its file and block, whatever its sent_id.
    With ``strict`` a token line without ten cells ends the query with an error."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))
    blocks = F.filter(F.split("text", "\n[ \t]*\n+"), lambda x: F.trim(F.replace(x, F.lit("\n"), F.lit(""))) != "")
    rows = files.select("file", F.posexplode(blocks).alias("block", "b"))
    sent = F.nullif(F.regexp_extract("b", "(?m)^#\\s*sent_id\\s*=\\s*(.*)$", 1), F.lit(""))
    rows = rows.select("file", "block", sent.alias("sent_id"), F.posexplode(F.filter(F.split("b", "\n"), lambda x: x != "")).alias("order", "line"))
    comment = F.col("line").startswith("#")
    cells = F.split("line", "\t")
    if strict:
        cells = F.when(comment | (F.size(cells) == 10), cells).otherwise(F.raise_error(F.concat(F.lit("a token line without ten cells: "), "line")).cast("array<string>"))
    return rows.withColumn("cells", cells).select("file", "block", "sent_id", "order", F.when(comment, F.col("line")).alias("comment"), *[F.when(~comment, F.get("cells", F.lit(k))).alias(n) for k, n in enumerate(CONLLU)])


def conllu_text(rows: DataFrame) -> DataFrame:
    """(file, block, value): each sentence's lines as they were read, with an empty line behind."""
    line = F.coalesce("comment", F.concat_ws("\t", *[F.coalesce(F.col(n), F.lit("_")) for n in CONLLU]))
    held = rows.select("file", "block", F.struct("order", line.alias("line")).alias("x")).groupBy("file", "block").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return held.select("file", "block", F.concat(F.array_join(F.transform("xs", lambda x: x["line"]), "\n"), F.lit("\n")).alias("value"))


def write_conllu(rows: DataFrame, path: str) -> None:
    """The inverse of ``read_conllu``: the sentences of each file together and in order."""
    text = conllu_text(rows).repartition("file").sortWithinPartitions("file", "block")
    text.select("value").write.mode("overwrite").text(path)


def graph_rows(edges: DataFrame, form: str = "gexf") -> DataFrame:
    """(place, value): the lines of a whole GEXF or GraphML file: a header, nodes with their degree,
    edges with their weight, a footer. Identical but for order of equal places."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id")))
    nodes = ends.groupBy("id").agg(F.count("*").alias("degree"))
    if form == "gexf":
        lines = ['<?xml version="1.0" encoding="UTF-8"?><gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="undirected"><attributes class="node"><attribute id="degree" title="degree" type="integer"/></attributes><nodes>', "</nodes><edges>", "</edges></graph></gexf>"]
        node = F.format_string('<node id="%s" label="%s"><attvalues><attvalue for="degree" value="%d"/></attvalues></node>', esc("id"), esc("id"), "degree")
        edge = F.format_string('<edge source="%s" target="%s" weight="%s"/>', esc("source"), esc("target"), F.col("weight").cast("string"))
    else:
        lines = ['<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="degree" for="node" attr.name="degree" attr.type="int"/><key id="weight" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="undirected">', "", "</graph></graphml>"]
        node = F.format_string('<node id="%s"><data key="degree">%d</data></node>', esc("id"), "degree")
        edge = F.format_string('<edge source="%s" target="%s"><data key="weight">%s</data></edge>', esc("source"), esc("target"), F.col("weight").cast("string"))
    fixed = edges.sparkSession.createDataFrame([(2 * k, x) for k, x in enumerate(lines) if x], "place int, value string")
    return fixed.unionByName(nodes.select(F.lit(1).alias("place"), node.alias("value"))).unionByName(edges.select(F.lit(3).alias("place"), edge.alias("value")))


def write_graph(edges: DataFrame, path: str, form: str = "gexf") -> None:
    """One file below ``path``, by one writer through which the lines stream."""
    graph_rows(edges, form).coalesce(1).sortWithinPartitions("place", "value").select("value").write.mode("overwrite").text(path)


def write_rdf(documents: DataFrame, path: str, base: str, fields: list[str]) -> None:
    """N-Triples of documents: a type, the identifier, and each field that isn't empty, as literals."""
    write = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), "\\\\", "\\\\\\\\"), '"', '\\\\"'), "\n", "\\\\n")
    subject = F.concat(F.lit(f"<{base}"), F.url_encode(F.col("doc_id").cast("string")), F.lit(">"))
    triples = [F.concat(subject, F.lit(f" <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <{base}Document> ."))]
    triples += [F.when(F.col(c).cast("string") != "", F.concat(subject, F.lit(f" <{base}{c}> \""), write(c), F.lit('" .'))) for c in ["doc_id", *fields]]
    documents.select(F.explode(F.array_compact(F.array(*triples))).alias("value")).write.mode("overwrite").text(path)
