"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again.

1. language: documents whose language can't be told (``und``: no text or no letters) go.
2. near_duplicates: of each group of linked documents one, that with the smallest id, stays.
3. decontamination: documents that hold a window of a benchmark item go.
4. secrets: secrets in texts are replaced by ``[REDACTED]`` and ``n_chars`` follows.
5. mixture: what is left is mixed to the source weights; the result says how many words of each document the mix takes.

Near duplicates are texts whose sets of 5-word shingles are alike by 80 % or
more. All but the last return the columns of ``documents``, whatever further
columns these hold. Every row is judged by its own text: null ids and ids that
several rows share are no reason to keep or drop one. Of rows that repeat an id
and a text one stays. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import decontaminate, language, mixture, secrets, shingle_join
from lodeseek.llm.store import Workspace


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learn = docs.where(~language.held_out(F.col("doc_id").cast("long"), 4, 2))
    return language.spoken(docs, language.learn(learn))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_join.deduplicated(docs, Workspace(spark, "near-duplicates"), percent=80, size=5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Workspace(spark, "decontamination"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return clean.select(*docs.columns)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.taken(docs)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("mixture", mixture_stage),
]

#: None: the kernel classifier of stage 1 and the entropy spans of stage 4 aren't SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``sf_dir``'s documents; every result but the last is written to the shared folder and read again."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done = ws.table(stage(spark, docs, sf_dir), name)
        ws.drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
