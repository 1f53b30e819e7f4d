"""Session helpers: defaults for a new session, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def get_spark(app_name: str = "tablescope", master: str | None = None, **conf) -> SparkSession:
    """Build a session with the settings the operators expect.

    On a cluster leave ``master`` unset; executor sizing and
    ``spark.checkpoint.dir`` come from the cluster's own configuration.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir`` of the
    session. Only a local session without one gets a temporary folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = spark.conf.get("tablescope.scratch", None)
    if not own:
        own = tempfile.mkdtemp(prefix="tablescope-")
        spark.conf.set("tablescope.scratch", own)
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/tablescope/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, freezes non-repeatable columns such as partition ids, and
    survives the loss of an executor because the files live outside it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_table(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A small literal table (rules, learnt parameters, per-column results)."""
    schema = T._parse_datatype_string(ddl) if isinstance(ddl, str) else ddl
    table = pa.Table.from_pylist(rows, schema=to_arrow_schema(schema))
    return spark.createDataFrame(table, schema=schema)


def in_parallel(spark: SparkSession, *jobs: Callable):
    """Start independent jobs side by side, so that small stages share the cluster;
    returns their results in order."""
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        return [w.result() for w in waiting]
