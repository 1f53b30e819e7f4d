"""Write tables, and keep analysis results keyed by ``dataset_id``.

A whole analysis is stored by version: its tables are appended under a new version of each dataset, and only then the ``current`` row of the
dataset is replaced, so a reader sees the old or the new analysis and never parts of both. With the row goes a digest of what was
analysed; an analysis of files whose listing has changed is made anew.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.profile import COLUMNS, CORRELATIONS, DISTRIBUTIONS, METRICS, Profile

_TABLES = {"metrics": METRICS, "columns": COLUMNS, "correlations": CORRELATIONS, "distributions": DISTRIBUTIONS}


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> str:
    """Write a cleaned or augmented table; returns the path."""
    writer = df.write.mode(mode)
    if format == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(format).save(path)
    return path


def save_profile(p: Profile, root: str) -> None:
    """One folder per result table, partitioned by dataset; saving a dataset
    again replaces only its own partition."""
    for f in fields(p):
        if f.name == "warnings":
            continue
        table: DataFrame = getattr(p, f.name)
        (table.repartition("dataset_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("dataset_id").parquet(f"{root}/{f.name}"))


def load_profile(spark: SparkSession, root: str, dataset_id: str | None = None) -> Profile:
    """Read stored results back; a given ``dataset_id`` reads only its partition."""
    out = {}
    for name, ddl in _TABLES.items():
        schema = T._parse_datatype_string(ddl)
        try:
            table = spark.read.schema(schema).parquet(f"{root}/{name}").select(schema.fieldNames())
        except Exception as problem:            # a table without any row has no files yet
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            table = spark.createDataFrame([], schema)
        out[name] = table if dataset_id is None else table.where(F.col("dataset_id") == dataset_id)
    return Profile(**out)


def profile_once(df: DataFrame, dataset_id: str, root: str) -> Profile:
    """The stored profile when there is one, else a fresh one that is stored."""
    from ..operators.profile import profile

    spark = df.sparkSession
    stored = load_profile(spark, root, dataset_id)
    if stored.metrics.limit(1).count() == 0:
        save_profile(profile(df, dataset_id), root)
        stored = load_profile(spark, root, dataset_id)
    return stored


def listing_digest(spark: SparkSession, path: str) -> str:
    """A digest of the names, lengths and times of the files under ``path``; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    row = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("h")).first()
    return f"{row['n']}-{row['h']}"


def _parts(analysis) -> dict[str, DataFrame]:
    tables = {f.name: getattr(analysis, f.name) for f in fields(analysis) if f.name != "profile"}
    return {**tables, **{f"profile_{name}": getattr(analysis.profile, name) for name in _TABLES}}


def save_analysis(analysis, root: str, digest: str = "") -> str:
    """Store every table of an analysis; returns the version."""
    version = uuid.uuid4().hex
    spark = analysis.score.sparkSession
    for name, table in _parts(analysis).items():
        # The schema is kept apart: a table without rows has no files.
        spark.createDataFrame([(table.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/schemas/{name}")
        table.withColumn("version", F.lit(version)).repartition("dataset_id").write.mode("append").partitionBy("dataset_id", "version").parquet(f"{root}/tables/{name}")
    now = analysis.profile.metrics.select("dataset_id", F.lit(version).alias("version"), F.lit(digest).alias("digest"))
    now.repartition("dataset_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id").parquet(f"{root}/current")
    return version


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as problem:            # nothing stored yet
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], schema)


def current(spark: SparkSession, root: str) -> DataFrame:
    """(dataset_id, version, digest) of the stored analyses."""
    return _stored(spark, f"{root}/current", T._parse_datatype_string("dataset_id string, version string, digest string"))


def load_analysis(spark: SparkSession, root: str, dataset_ids: list[str] | None = None):
    """The stored analysis of the given datasets (all by default), or None where there is none."""
    from ..plans.analyze import Analysis

    now = current(spark, root)
    if dataset_ids is not None:
        now = now.where(F.col("dataset_id").isin(dataset_ids))
    if not now.limit(1).count():
        return None
    now = now.select("dataset_id", "version")

    def table(name: str) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(spark.read.text(f"{root}/schemas/{name}").first()[0]))
        rows = _stored(spark, f"{root}/tables/{name}", T.StructType([*schema.fields, T.StructField("version", T.StringType())]))
        return rows.join(now, ["dataset_id", "version"], "left_semi").select(schema.fieldNames())

    parts = {f.name: table(f.name) for f in fields(Analysis) if f.name != "profile"}
    return Analysis(profile=Profile(**{name: table(f"profile_{name}") for name in _TABLES}), **parts)


def analyze_once(spark: SparkSession, dataset_id: str, path: str, root: str, read: Callable[[SparkSession, str], DataFrame] | None = None):
    """(analysis, fresh): the stored analysis of the files under ``path`` while their listing is the same, else a new one that is stored."""
    from ..plans.analyze import analyze

    digest = listing_digest(spark, path)
    known = current(spark, root).where((F.col("dataset_id") == dataset_id) & (F.col("digest") == digest)).limit(1).count()
    if not known:
        table = read(spark, path) if read else spark.read.parquet(path)
        save_analysis(analyze({dataset_id: table}), root, digest)
    return load_analysis(spark, root, [dataset_id]), not known
