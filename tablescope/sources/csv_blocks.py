"""CSV records that go over line ends, read by many tasks.

Whether a line starts inside quotes depends on all lines before it. But a line, whatever it holds, maps the two possible states at its start
(outside or inside quotes) to states at its end, and such maps compose. So one pass gives each byte range of a file its map; composing the maps
of a file's ranges in order (a row for each range) tells every range the state it starts in; a second pass cuts each range into records. A range's
first lines may end a record of an earlier range: these pieces are a row for each range at most, and are joined to the record they belong to.

Inside a field only a quote at its beginning opens it, and a doubled quote is one character, as RFC 4180 has it.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

_KEYS = ["file", "block"]


def _stays_open(text: Column, sep: str) -> Column:
    """Whether quotes are open at the end of ``text``, which starts outside of them."""
    s = re.escape(sep)
    # Fields from the left, each as a whole; what is left over starts with a quote that nothing closes.
    rest = F.regexp_replace(text, rf'\A(?:(?:"(?:[^"]++|"")*+"(?!")[^{s}]*+|(?!")[^{s}]*+)(?:{s}|\z))*+', "")
    return F.startswith(rest, F.lit('"'))


def _lines(spark: SparkSession, paths: list[str] | str, sep: str, encoding: str) -> DataFrame:
    """(file, block, place, line, from_outside, from_inside): lines in the order of each byte range, and the state each leaves."""
    raw = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                        F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    if encoding != "UTF-8":
        raw = raw.withColumn("line", F.decode(F.col("line").cast("binary"), encoding))
    return raw.withColumns({"from_outside": _stays_open(F.col("line"), sep), "from_inside": _stays_open(F.concat(F.lit('"'), "line"), sep)})


def _maps(lines: DataFrame) -> DataFrame:
    """(file, block, outside, inside): the state at a range's end for each state at its start."""
    def run(batches):
        state: dict[tuple, list[bool]] = {}
        for b in batches:
            for file, block, outside, inside in zip(*[b.column(c).to_pylist() for c in (*_KEYS, "from_outside", "from_inside")]):
                now = state.setdefault((file, block), [False, True])
                now[:] = [inside if s else outside for s in now]
        if state:
            names, ends = list(zip(*state)), list(zip(*state.values()))
            yield pa.RecordBatch.from_arrays([pa.array(names[0]), pa.array(names[1], pa.int64()), pa.array(ends[0]), pa.array(ends[1])],
                                             names=["file", "block", "outside", "inside"])

    return lines.select(*_KEYS, "from_outside", "from_inside").mapInArrow(run, "file string, block bigint, outside boolean, inside boolean")


def _starts(maps: DataFrame) -> DataFrame:
    """(file, block, starts_inside): the maps of the ranges before, composed. A file's list has a small struct for each of its ranges."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.collect_list(F.struct("outside", "inside")).over(before)
    return maps.select(*_KEYS, F.aggregate(earlier, F.lit(False), lambda s, m: F.when(s, m["inside"]).otherwise(m["outside"])).alias("starts_inside"))


def _pieces(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """(file, block, no, text, whole): the records that begin in each range, and as number -1 the lines that end an earlier one. ``whole`` is false
    where the text goes on in the next range."""
    known = starts.select(F.col("file").alias("f"), F.col("block").alias("b"), "starts_inside")
    rows = (lines.join(known, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
            .select(*_KEYS, "place", "line", "from_outside", "from_inside", "starts_inside").sortWithinPartitions(*_KEYS, "place"))

    def run(batches):
        at, text, no, inside = None, [], 0, False
        out: list[tuple] = []

        def flush():
            done = list(zip(*out))
            out.clear()
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(done, kinds)], names=[*_KEYS, "no", "text", "whole"])

        for b in batches:
            for file, block, line, outside_to, inside_to, starts_inside in zip(
                    *[b.column(c).to_pylist() for c in (*_KEYS, "line", "from_outside", "from_inside", "starts_inside")]):
                if (file, block) != at:
                    if text:
                        out.append((*at, no, "\n".join(text), False))
                    at, text, inside = (file, block), [], starts_inside
                    no = -1 if inside else 0
                text.append(line)
                inside = inside_to if inside else outside_to
                if not inside:
                    out.append((file, block, no, "\n".join(text), True))
                    text, no = [], no + 1
            if out:
                yield flush()
        if text:
            out.append((*at, no, "\n".join(text), False))
        if out:
            yield flush()

    return rows.mapInArrow(run, "file string, block bigint, no bigint, text string, whole boolean")


def records(spark: SparkSession, paths: list[str] | str, sep: str, encoding: str) -> DataFrame:
    """(file, block, no, text): every record as text, without the empty ones; number 0 of block 0 is a file's header."""
    lines = _lines(spark, paths, sep, encoding)
    starts = materialize(_starts(_maps(lines)), "csv-starts")
    pieces = materialize(_pieces(lines, starts), "csv-pieces")
    # An open piece is completed by the number -1 pieces after it, up to the first that is whole: an island of ranges, as a rule of two.
    open_ends = pieces.where("(no >= 0 and not whole) or no = -1")
    island = F.sum((F.col("no") >= 0).cast("int")).over(Window.partitionBy("file").orderBy("block", "no"))     # two rows a range at most
    joined = (open_ends.withColumn("island", island).groupBy("file", "island")
              .agg(F.min_by(F.struct("block", "no"), F.struct("block", "no")).alias("first"),
                   F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "no", "text"))), lambda p: p["text"]), "\n").alias("text"))
              .select("file", "first.block", "first.no", "text"))
    return pieces.where("no >= 0 and whole").drop("whole").unionByName(joined).where(F.length("text") > 0)
