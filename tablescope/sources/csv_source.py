"""Lenient CSV reading.

One pass over the lines gives one small row per file: its first line, whether it is UTF-8, how many fields each separator
gives, and whether quotes stay open at a line's end. Files of one layout are read together and matched by column name. A record with more
fields than its header is found from the record itself. Like the listing of a folder, only that row per file reaches the driver.
"""

from __future__ import annotations

import csv
import io
import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import quoted
from .csv_blocks import records

# Separators that are tried, and texts that stand for a missing value.
SEPARATORS = [",", ";", "\t", "|"]
_EXTRA, _RAW = "_too_many_fields", "_record"
NULL_TEXTS = ["", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
              "NULL", "NaN", "None", "n/a", "nan", "null"]


class UnreadableFileError(ValueError):
    """No reading strategy gave a row."""


def _fields(text: str, sep: str) -> list[str]:
    return next(csv.reader(io.StringIO(text), delimiter=sep), [])


def _layouts(spark: SparkSession, path: str) -> list[dict]:
    """One dict per file with text: path, first line, utf8, open_quotes, and its separator. The separator is the comma where all lines
    agree on it, else the one whose most frequent number of fields covers the most lines, then the larger number."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), "value", F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"))
    bare = F.regexp_replace("value", '"[^"]*+"', "")
    fields = [F.when(F.col("value") != "", F.length(bare) - F.length(F.translate(bare, sep, "")) + 1) for sep in SEPARATORS]
    raw = F.col("value").cast("binary")
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    widths = (lines.groupBy("file", F.array(*fields).alias("fields"))
              .agg(F.count("*").alias("n"), F.min_by(raw, "place").alias("line"), F.min("place").alias("place"),
                   F.every(F.is_valid_utf8("value")).alias("utf8"), F.some(quotes % 2 == 1).alias("open_quotes")))
    each = widths.select("*", F.posexplode("fields").alias("sep", "width"))
    shares = (each.where("width is not null").groupBy("file", "sep", "width").agg(F.sum("n").alias("n")).groupBy("file", "sep")
              .agg((F.max(F.struct("n", "width"))).alias("best"), F.sum("n").alias("total"))
              .select("file", "sep", F.col("best.width").alias("width"), (F.col("best.n") / F.col("total")).alias("share")).where("width > 1"))
    rank = F.struct(((F.col("sep") == 0) & (F.col("share") == 1)).alias("plain"), "share", "width", -F.col("sep"))
    chosen = shares.groupBy("file").agg(F.max_by("sep", rank).alias("sep")).withColumnRenamed("file", "f")
    facts = widths.groupBy("file").agg(F.min_by("line", "place").alias("line"), F.every("utf8").alias("utf8"), F.some("open_quotes").alias("open_quotes"))
    rows = facts.join(chosen, F.col("file") == F.col("f"), "left").select("file", "line", "utf8", "open_quotes", "sep").orderBy("file").collect()
    return [{"path": r["file"], "utf8": r["utf8"], "open_quotes": r["open_quotes"], "sep": SEPARATORS[r["sep"] or 0],
             "header": bytes(r["line"]).decode("utf-8-sig" if r["utf8"] else "latin-1")} for r in rows]


def _literal(path: str) -> str:
    """A listed path as the readers take it: not percent-coded, and no character of it is a wildcard."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(path))


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _texts(spark: SparkSession, paths: list[str] | str, names: list[str], sep: str, encoding: str, multi_line: bool) -> DataFrame:
    """The records of files of one layout as texts, plus _EXTRA: whether a record has more fields than its header.
    Short records keep their fields and get nulls for the rest."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _RAW]])
    how = dict(sep=sep, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=_RAW)
    if multi_line:
        ddl = ", ".join(f"{_name(n)} string" for n in schema.names)
        # Each record is parsed from its text; a blank line within a file is no record, as for the reader of plain files.
        found = records(spark, paths, sep, encoding).where("not (block = 0 and no = 0)")
        parsed = found.select(F.from_csv("text", ddl, how).alias("r")).select("r.*")
    else:
        parsed = spark.read.schema(schema).options(header=True, encoding=encoding, enforceSchema=True, columnPruning=False, **how).csv(paths)
    # Spark keeps the record where its fields are more or fewer than the columns; its fields are counted. It refuses a query that
    # needs the kept record alone, so nothing of the first column is put in front.
    s = re.escape(sep)
    record = F.concat(F.substring(F.coalesce(quoted(names[0]), F.lit("")), 1, 0), F.lit(sep), F.regexp_replace(_RAW, r"[\r\n]+\z", ""))
    count = F.regexp_count(record, F.lit(f'{s}(?:"(?:[^"]++|"")*+"[^{s}]*+|[^{s}]*+)'))
    value = lambda n: F.when(quoted(n).isin(NULL_TEXTS), None).otherwise(quoted(n)).alias(n)     # noqa: E731
    return parsed.select(*map(value, names), F.coalesce(count > len(names), F.lit(False)).alias(_EXTRA))


def _infer(texts: DataFrame, names: list[str]) -> tuple[T.StructType, int, int]:
    """(narrowest type per column that reads every value, good rows, overlong
    rows), in one job."""
    extra = F.col(_EXTRA)
    texts = texts.select([F.when(~extra, quoted(n)).alias(n) for n in names] + [_EXTRA])
    tests = {"bigint": "bigint", "double": "double", "boolean": "boolean"}
    aggs = [F.count(F.when(~extra, True)).alias("good"), F.count(F.when(extra, True)).alias("bad")]
    for i, n in enumerate(names):
        v = quoted(n)
        aggs.append(F.count(v).alias(f"n{i}"))
        aggs += [F.count(v.try_cast(t)).alias(f"{k}{i}") for k, t in tests.items()]
        aggs.append(F.count(F.when(F.lower(v).isin("true", "false"), True)).alias(f"flag{i}"))
    row = texts.agg(*aggs).first()
    fields = []
    for i, n in enumerate(names):
        total = row[f"n{i}"]
        if total == 0:
            kind: T.DataType = T.StringType()
        elif row[f"flag{i}"] == total:
            kind = T.BooleanType()
        elif row[f"bigint{i}"] == total:
            kind = T.LongType()
        elif row[f"double{i}"] == total:
            kind = T.DoubleType()
        else:
            kind = T.StringType()
        fields.append(T.StructField(n, kind))
    return T.StructType(fields), row["good"], row["bad"]


def read_csv(spark: SparkSession, path: str, max_rows: int | None = None, order_by: list[str] | None = None,
             multi_line: bool | None = None) -> tuple[DataFrame, list[str]]:
    """(table, warnings).

    Header, separator and encoding are each file's own; columns of several files are matched by name, and one that a file lacks is
    null there. Files in which quotes stay open at a line's end are read with line breaks inside fields (``multi_line`` decides it for all
    files). Records with more fields than the header are left out and counted in a warning. There is no row cap unless ``max_rows`` is given.
    """
    warnings: list[str] = []
    files = _layouts(spark, path)
    if not files:
        raise UnreadableFileError(f"nothing to read in {path}")
    latin = sum(not f["utf8"] for f in files)
    if latin:
        warnings.append(f"{latin} of {len(files)} files are not UTF-8 and were read as ISO-8859-1.")
    groups: dict[tuple, list[str]] = {}
    split = sum(f["open_quotes"] if multi_line is None else multi_line for f in files)
    if split:
        warnings.append(f"{split} of {len(files)} files have line breaks inside quotes and were read twice to find their records.")
    for f in files:
        broken = f["open_quotes"] if multi_line is None else multi_line
        encoding = "UTF-8" if f["utf8"] else "ISO-8859-1"
        if broken and f["header"].count('"') % 2:       # the header itself goes on in the next line
            first = spark.read.options(sep=f["sep"], encoding=encoding, quote='"', escape='"', multiLine=True).csv(_literal(f["path"])).first()
            names = [x or "" for x in first]
        else:
            names = _fields(f["header"], f["sep"])
        groups.setdefault((tuple(_unique(names)), f["sep"], encoding, broken), []).append(_literal(f["path"]))
    tables = [_texts(spark, path if len(groups) == 1 else paths, list(names), *how) for (names, *how), paths in groups.items()]
    texts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    texts = texts.select(*[quoted(c) for c in texts.columns if c != _EXTRA], _EXTRA)
    schema, good, bad = _infer(texts, texts.columns[:-1])
    if bad:
        warnings.append(f"Records with more fields than the header were left out: {bad}.")
    if not good:
        raise UnreadableFileError(f"no readable row in {path}")
    out = texts.where(~F.col(_EXTRA)).select([quoted(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    if max_rows is not None:
        from ..operators.profile import row_cap

        out, more = row_cap(out, max_rows, order_by or names)
        warnings += more
    return out, warnings


def _unique(names: list[str]) -> list[str]:
    """Column names made distinct: a repeated name gets .1, .2, an empty one a number."""
    seen: dict[str, int] = {}
    out = []
    for i, n in enumerate(names):
        n = n or f"column_{i}"
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(n if k == 0 else f"{n}.{k}")
    return out
