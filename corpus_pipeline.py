"""The corpus pipeline: quality rules, near-dedup, decontamination, secrets, packing.

Each stage works on all documents that the one before it kept, and its
decisions take effect: rejected documents, all but one of a group of near
copies, and documents with benchmark passages go; lines above the quality limits
and secrets are taken out of the texts; the last stage packs what is left.

Defined cases, of every stage: a null or empty text fails the quality rules, so none comes
further; repeated rows of one id and text share a verdict, and one of them stays in near_dedup;
of a group of near copies the document of the least id stays, null ids before all others, ties
by the text's hash; ids may be of any type, null or shared by different texts; columns of any name pass through up to packing; an
empty table gives an empty result; a benchmark without words takes nothing out.
Each stage's rows are deleted once the next one's are written; checkpoints go with
spark.cleaner.referenceTracking.cleanCheckpoints.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm.common import drop_folder, shared_folder
from lexloom.llm.decontaminate import drop_contaminated
from lexloom.llm.neardup import STAGE_PERCENT, STAGE_SHINGLE, drop_near_duplicates
from lexloom.llm.packing import pack
from lexloom.llm.quality import apply_rules
from lexloom.llm.secrets import redact_secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return apply_rules(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, STAGE_PERCENT, STAGE_SHINGLE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Tokenization and similarity components have no SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            drop_folder(spark, before)
        before = f"{folder}/{name}"
    return docs
