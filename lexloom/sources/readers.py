"""Landed files as tables: index archives, snapshots, graphs, query sets, documents, answers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX = "pcode string, name string, level string, category string, modified_date string, effective_date string, abolished boolean"
_LAW = "struct<LawName:string,LawLevel:string,LawCategory:string,LawURL:string,LawModifiedDate:string,LawEffectiveDate:string,LawAbandonNote:string>"


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for path, content in zip(batch["path"], batch["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                name = next((n for n in z.namelist() if n.endswith(".json")), None)
                if name is None:
                    raise ValueError(f"no JSON file in {path}")
                out.append((path, z.read(name).decode("utf-8-sig")))
        yield pd.DataFrame(out, columns=["path", "json"])


def index_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows of landed index archives: the first JSON file of each, a list of laws or an object with Laws; the archives of a run are one union."""
    from lexloom.functions import text as T

    files = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_members, "path string, json string")
    laws = F.coalesce(F.from_json("json", f"struct<Laws:array<{_LAW}>>")["Laws"], F.from_json("json", f"array<{_LAW}>"))
    rows = files.select("path", F.posexplode(laws).alias("pos", "law"))
    return rows.select(
        "path", "pos", T.pcode(F.col("law.LawURL")).alias("pcode"), F.col("law.LawName").alias("name"), F.col("law.LawLevel").alias("level"), F.col("law.LawCategory").alias("category"),
        F.col("law.LawModifiedDate").alias("modified_date"), F.col("law.LawEffectiveDate").alias("effective_date"), (F.coalesce(F.col("law.LawAbandonNote"), F.lit("")) != "").alias("abolished"),
    ).where("pcode != ''")


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(pcode, version, article_no, text) of snapshot files {version: {article: text}} named by their pcode, or in folders pcode=…; internal versions begin with _."""
    pcode = F.coalesce(F.nullif(F.regexp_extract(F.input_file_name(), r"/pcode=([^/]+)/", 1), F.lit("")), F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    files = spark.read.text(path, wholetext=True).select(pcode.alias("pcode"), F.from_json("value", "map<string,map<string,string>>").alias("m"))
    versions = files.select("pcode", F.explode("m").alias("version", "articles")).where(~F.col("version").startswith("_"))
    return versions.select("pcode", "version", F.explode("articles").alias("article_no", "text"))


def snapshot_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same rows from files of many laws, one {pcode, versions} a line."""
    laws = spark.read.schema("pcode string, versions map<string,map<string,string>>").json(path)
    versions = laws.select("pcode", F.explode("versions").alias("version", "articles")).where(~F.col("version").startswith("_"))
    return versions.select("pcode", "version", F.explode("articles").alias("article_no", "text"))


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of graph files; missing metadata is an empty map."""
    schema = "nodes array<struct<id:string,label:string,type:string,metadata:map<string,string>>>, edges array<struct<source:string,target:string,type:string,metadata:map<string,string>>>"
    file = spark.read.schema(schema).json(path, multiLine=True)
    empty = F.create_map().cast("map<string,string>")
    nodes = file.select(F.explode("nodes").alias("n")).select("n.id", "n.label", "n.type", F.coalesce("n.metadata", empty).alias("metadata"))
    edges = file.select(F.explode("edges").alias("e")).select(F.col("e.source").alias("src"), F.col("e.target").alias("dst"), "e.type", F.coalesce("e.metadata", empty).alias("metadata"))
    return nodes, edges


def query_set(spark: SparkSession, path: str) -> DataFrame:
    """(id, query, expected_articles, domain) of retrieval query files."""
    file = spark.read.schema("queries array<struct<id:string,query:string,expected_articles:array<string>,domain:string>>").json(path, multiLine=True)
    return file.select(F.explode("queries").alias("q")).select("q.*")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw) of text files, whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("raw"))
