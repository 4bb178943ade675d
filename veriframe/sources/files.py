"""File sources: explicit schemas, no inference, missing artifacts by anti join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COREG = "session int, scan_idx int, unit_id bigint, pt_root_id bigint"
#: Names of one store in Spark's file systems and in Arrow's.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss"}


def arrow_uri(path: str) -> str:
    """The path as Arrow's file systems spell it; one without a scheme is a local (or mounted) path."""
    if "://" not in path:
        return path if path.startswith("file:") else f"file://{path}"
    scheme, rest = path.split("://", 1)
    return f"{SCHEMES.get(scheme, scheme)}://{rest}"


def filesystem(path: str):
    """(file system, path inside it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(arrow_uri(path))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One document per line; blank lines drop out as all-null rows."""
    df = spark.read.schema(schema).json(path)
    return df.dropna(how="all")


def read_json_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON artifacts as text with their path; fields are read later by path expressions."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("payload"))


def missing_artifacts(expected: DataFrame, artifacts: DataFrame) -> DataFrame:
    return expected.join(artifacts.select("path"), "path", "left_anti")


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.option("header", True).schema(schema).csv(path)
    return df.select(*columns) if columns else df


def read_headerless_csv(spark: SparkSession, path: str, schema: str = COREG) -> DataFrame:
    return spark.read.schema(schema).csv(path)


def whitespace_table(lines: DataFrame, key: list[str], column: str = "value", minimum: int = 1) -> DataFrame:
    """Whitespace-separated numbers as (key, col, value); short lines are dropped."""
    parts = lines.withColumn("_p", F.split(F.trim(F.col(column)), r"\s+")).filter(F.size("_p") >= minimum)
    return parts.select(*key, F.posexplode("_p").alias("col", "_v")).select(*key, "col", F.col("_v").try_cast("double").alias("number"))


def pair_metadata(lines: DataFrame, column: str = "value") -> DataFrame:
    """Pair id, zero-based column ranges and weight from lines of at least six fields."""
    p = F.split(F.trim(F.col(column)), r"\s+")
    m = lines.withColumn("_p", p).filter(F.size("_p") >= 6)
    c = lambda i: F.col("_p")[i].cast("int")
    return m.select(c(0).alias("pair"), (c(1) - 1).alias("cause_start"), c(2).alias("cause_end"), (c(3) - 1).alias("effect_start"), c(4).alias("effect_end"), F.col("_p")[5].cast("double").alias("weight"))


def read_manuscripts(spark: SparkSession, patterns: list[str], fallback: list[str]) -> DataFrame:
    """Texts of the first pattern list that matches a file, otherwise of the fallback list."""
    for group in (patterns, fallback):
        df = spark.read.option("ignoreMissingFiles", True)
        found = [p for p in group if _exists(spark, p)]
        if found:
            return df.text(found, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    raise FileNotFoundError(f"no file matches {patterns + fallback}")


def _exists(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def verify_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """SHA-256 and size of each file against a manifest (name, sha256, bytes); absent files are kept."""
    files = spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found_sha256"), F.col("length").alias("found_bytes"))
    j = manifest.join(files, "name", "left")
    return j.withColumn("ok", F.col("sha256").eqNullSafe(F.col("found_sha256")) & F.col("bytes").eqNullSafe(F.col("found_bytes")))


def join_trials(stimuli: DataFrame, responses: DataFrame, covariates: DataFrame, width: int) -> DataFrame:
    """Trials with both sides; a missing covariate vector becomes zeros of the declared width."""
    zeros = F.array_repeat(F.lit(0.0), width)
    return stimuli.join(responses, "trial_id").join(covariates, "trial_id", "left").withColumn("context", F.coalesce("context", zeros))
