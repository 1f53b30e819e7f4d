"""Find the main file of each dataset folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOOK = 64              # characters of a line that tell a web page
_TEXT = r"(?U)[^\s\x1c-\x1f]"


def first_lines(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """(path, length, line) of every file under ``root`` that is not empty: the start of its first line with text.

    One job, whatever the number of folders. Files are read in splits of bounded size, each split gives its first line with text, and
    the first split of a file that has one counts; so no task reads a whole large file.
    """
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(root)
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))      # the path is a URI, in which a plus sign stands for itself
    start = lines.select(name.alias("path"), F.col("_metadata.file_size").alias("length"),
                         F.col("_metadata.file_block_start").alias("at"), F.substring(F.ltrim("value"), 1, _LOOK).alias("line"), F.monotonically_increasing_id().alias("no")).where("length > 0")
    # A split is one task's, which numbers its lines in order.
    splits = start.groupBy("path", "length", "at").agg(F.min_by("line", F.when(F.col("line").rlike(_TEXT), F.col("no"))).alias("line"))
    first = F.min_by("line", F.when(F.col("line").isNotNull(), F.col("at")))
    return splits.groupBy("path", "length").agg(F.coalesce(first, F.lit("")).alias("line"))


def discover_files(spark: SparkSession, root: str, max_bytes: int | None = None, pattern: str = "*.csv") -> DataFrame:
    """(dataset, path, length): the largest usable file per first-level folder, the first by path on ties.

    Empty files, saved HTML pages and, with ``max_bytes``, larger files are passed over. Neither paths nor lines
    come to the driver, and the number of jobs does not depend on the number of folders.
    """
    base = root.rstrip("/").split("/")[-1]
    line = F.lower(F.regexp_replace("line", r"^\s+", ""))
    usable = first_lines(spark, root, pattern).where(~(line.startswith("<!doctype") | line.startswith("<html")))
    if max_bytes is not None:
        usable = usable.where(F.col("length") <= max_bytes)
    dataset = F.regexp_extract("path", rf"/\Q{base}\E/([^/]+)/", 1)
    best = usable.groupBy(dataset.alias("dataset")).agg(F.min(F.struct((-F.col("length")).alias("less"), "path")).alias("best"))
    return best.select("dataset", "best.path", (-F.col("best.less")).alias("length"))
