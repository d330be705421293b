"""Evaluation: findings against known secrets, as set operations on fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNITS = {"occurrence": ("project_id", "artifact_id", "fingerprint", "location"), "project_unique": ("project_id", "fingerprint")}


def set_counts(expected: DataFrame, predicted: DataFrame, unit: str) -> DataFrame:
    """One row: unit, tp, fp, fn over the distinct keys of the unit."""
    keys = list(UNITS[unit])
    e = expected.select(*keys, F.lit(1).alias("e"), F.lit(0).alias("p"))
    p = predicted.select(*keys, F.lit(0).alias("e"), F.lit(1).alias("p"))
    both = e.unionByName(p).groupBy(*keys).agg(F.max("e").alias("e"), F.max("p").alias("p"))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return both.agg(n((F.col("e") == 1) & (F.col("p") == 1)).alias("tp"), n(F.col("e") == 0).alias("fp"), n(F.col("p") == 0).alias("fn")).select(F.lit(unit).alias("unit"), "tp", "fp", "fn")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def metrics(counts: DataFrame) -> DataFrame:
    """``counts`` (tp, fp, fn) with precision, recall, f1 and fdr; 0 where a denominator is 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    c = counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "fdr": ratio(fp, tp + fp)})
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def scored(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    return metrics(set_counts(expected, predicted, "occurrence").unionByName(set_counts(expected, predicted, "project_unique")))


MANIFEST = (
    "schema_version string, dataset_id string, root string, artifacts array<struct<artifact_id:string, project_id:string, relative_path:string, sha256:string, mime:string, "
    "secrets:array<struct<fingerprint:string, location:string, credential_type:string>>>>"
)


def manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(artifacts, truth) of a JSON manifest; malformed manifests and paths that leave the root raise an error."""
    m = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)
    a = m.select("schema_version", "dataset_id", "root", F.explode("artifacts").alias("a")).select("schema_version", "dataset_id", "root", "a.*")
    ok = (F.col("schema_version") == "1.0") & F.col("sha256").rlike("^[0-9a-f]{64}$") & ~F.col("relative_path").startswith("/") & ~F.array_contains(F.split("relative_path", "/"), "..")
    bad = a.where(~F.coalesce(ok, F.lit(False))).select("artifact_id").head()
    if bad is not None:
        raise ValueError(f"manifest entry is malformed: {bad['artifact_id']}")
    truth = a.select("project_id", "artifact_id", F.explode("secrets").alias("s")).select("project_id", "artifact_id", "s.fingerprint", "s.location", "s.credential_type")
    return a.select("dataset_id", "artifact_id", "project_id", "root", "relative_path", "sha256", "mime"), truth


def changed(artifacts: DataFrame, objects: DataFrame) -> DataFrame:
    """Artifacts (relative_path, sha256) whose content (root_path, data) has another hash or is missing."""
    have = objects.select(F.col("root_path"), F.sha2("data", 256).alias("have"))
    path = F.concat_ws("/", F.rtrim(F.col("root")), "relative_path")
    return artifacts.join(have, have.root_path.endswith(path), "left").where(F.col("have").isNull() | (F.col("have") != F.col("sha256"))).select("artifact_id", "sha256", "have")
