"""Repeated runs of lines, found with a suffix array over line ids that prefix doubling builds, and deleted in their later copies.

Lines that occur once break every run, so the array holds the repeated ones only. Round k sorts the suffixes by their first
2^k lines: a suffix's rank is the place of (its rank for 2^(k-1) lines, that of the suffix 2^(k-1) lines on) among all such pairs, one
range-partitioned sort of the distinct pairs. Suffixes that share their first n lines stand together in this order: an interval of
longest common prefix n or more, which two ranks name exactly, those of its first and of its last 2^k <= n lines.

A run counts from ``min_words`` words. Every such run is covered by the shortest runs of that size that start, or end, at its lines;
where one of these stands earlier too, the later copy's lines go. That is the union of all maximal repeated runs, so the doubling can
stop at the lines that a shortest run has, at most log2(min_words) rounds.

Earlier means: smaller id (null last), then text hash, then line. Blank lines are no part of a run; one that follows a deleted line goes
with it. Defined results: null texts stay null; empty texts stay; rows with equal id and text are one document and are treated alike;
runs may overlap themselves (of a line said over and over, the first stays); an empty table gives an empty result; very long texts are
lines like others, a document's at once in a task; columns called n_lines or n_deleted make the output columns take underscores.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .kernel import word_counts
from .shared import dense_ranks, free_name, may_hold, quoted

MIN_WORDS = 20


def _shortest(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """How many lines the shortest run of ``least`` words has that starts, or ends, at each line; 0 for none."""
    sums = np.concatenate([[0], np.cumsum(words)])
    i = np.arange(len(words))
    stop = np.searchsorted(sums, sums[:-1] + least)
    begin = np.searchsorted(sums, sums[1:] - least, "right") - 1
    return np.where(stop <= len(words), stop - i, 0), np.where(begin >= 0, i - begin + 1, 0)


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(id, th, n, line, from_here, to_here) for each line that is not blank; ``line`` is a 128-bit digest."""
    schema = T.StructType([docs.schema["id"], docs.schema["th"]]).add("n", "long").add("line", T.BinaryType()).add("from_here", "integer").add("to_here", "integer")

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                digests, row, n, first, last = [], [], [], [], []
                for i, text in enumerate(part.column("text")):
                    lines = [x for x in (text.as_py() or "").split("\n") if x.strip(" \t\n\v\f\r")]
                    if not lines:
                        continue
                    data = pa.array(lines, pa.large_string())
                    a, z = _shortest(word_counts(data), min_words)
                    digests += [hashlib.blake2b(x.encode(), digest_size=16).digest() for x in lines]
                    row.append(np.full(len(lines), i))
                    n.append(np.arange(len(lines)))
                    first.append(a)
                    last.append(z)
                if digests:
                    rows = pa.array(np.concatenate(row))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(rows), part.column("th").take(rows), pa.array(np.concatenate(n)), pa.array(digests, pa.binary()),
                         pa.array(np.concatenate(first).astype(np.int32)), pa.array(np.concatenate(last).astype(np.int32))], names=schema.names)

    return docs.mapInArrow(run, schema)


def suffix_ranks(lines: DataFrame) -> tuple[DataFrame, int]:
    """Rows of repeated lines with ``ranks``, an array: the suffix's rank by its first 1, 2, 4, ... lines, null where that prefix
    occurs once; and the number of ranks."""
    counts = lines.groupBy("line").agg(F.count("*").alias("c")).where("c > 1").select("line")
    ranked = materialize(dense_ranks(counts, ["line"], "lines").select(F.col("line").alias("l"), "rank"), "line-ids")
    some = may_hold(lines, F.col("line"), ranked.select("l"), "_often").where("_often")
    table = materialize(some.join(ranked, F.col("line") == F.col("l")).select("id", "th", "n", "from_here", "to_here", F.array("rank").alias("ranks")), "suffixes")
    deepest = table.agg(F.max(F.greatest("from_here", "to_here"))).first()[0] or 0
    level = 0
    while 2 << level <= deepest:
        far = Window.partitionBy("id", "th").orderBy("n").rangeBetween(1 << level, 1 << level)      # one document's lines
        last = F.element_at("ranks", level + 1)
        paired = table.withColumn("a", last).withColumn("b", F.first(last).over(far))
        pairs = paired.where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("c")).where("c > 1").select("a", "b")
        names = materialize(dense_ranks(pairs, ["a", "b"], "pairs").select(F.col("a").alias("x"), F.col("b").alias("y"), "rank"), "ranks")
        table = materialize(paired.join(names, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left").select(
            "id", "th", "n", "from_here", "to_here", F.concat("ranks", F.array("rank")).alias("ranks")), "suffixes")
        level += 1
    return table, level + 1


def _intervals(table: DataFrame) -> DataFrame:
    """(id, th, start, lines, a, b): each shortest run and the two ranks that name its interval."""
    held = F.struct("n", "from_here", "to_here", "ranks")
    docs = table.groupBy("id", "th").agg(F.collect_list(held).alias("suffixes"))       # one document's lines
    schema = T.StructType([table.schema["id"], table.schema["th"]]).add("start", "long").add("lines", "integer").add("a", "long").add("b", "long")

    def run(batches):
        for batch in batches:
            rows, out = [], []
            for i, suffixes in enumerate(batch.column("suffixes")):
                at = {s["n"]: s for s in suffixes.as_py()}
                for n, s in at.items():
                    for start, size in {(n, s["from_here"]), (n - s["to_here"] + 1, s["to_here"])}:
                        if not size:
                            continue
                        k = size.bit_length() - 1
                        first, last = at.get(start), at.get(start + size - (1 << k))
                        if first and last and first["ranks"][k] is not None and last["ranks"][k] is not None:
                            rows.append(i)
                            out.append((start, size, first["ranks"][k], last["ranks"][k]))
            rows = pa.array(rows, pa.int64())
            start, size, a, b = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("th").take(rows), pa.array(start, pa.int64()),
                                              pa.array(size, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=schema.names)

    return docs.mapInArrow(run, schema).distinct()


def later_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, runs): per document the runs (start, lines), by lines that are not blank, that an earlier run equals."""
    rows = docs.select(quoted(id_col).alias("id"), F.xxhash64(quoted(text)).alias("th"), quoted(text).alias("text"))
    lines = materialize(_lines(rows, min_words).dropDuplicates(["id", "th", "n"]), "lines")
    table, _ = suffix_ranks(lines)
    runs = materialize(_intervals(table), "runs")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "th", "start")
    first = materialize(runs.groupBy("lines", "a", "b").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1")
                        .select(F.col("lines").alias("l"), F.col("a").alias("x"), F.col("b").alias("y"), "first"), "first")
    later = runs.join(first, (F.col("lines") == F.col("l")) & (F.col("a") == F.col("x")) & (F.col("b") == F.col("y"))).where(place > F.col("first"))
    return later.groupBy("id", "th").agg(F.collect_list(F.struct("start", "lines")).alias("runs"))


def _cut(text: str, runs: list[dict]) -> tuple[str, int, int]:
    """(text without the runs, its lines before, lines deleted)"""
    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if x.strip(" \t\n\v\f\r")]
    gone = np.zeros(len(full) + 1, np.int64)
    for r in runs:
        gone[r["start"]] += 1
        gone[r["start"] + r["lines"]] -= 1
    dropped = {i for i, g in zip(full, np.cumsum(gone)) if g > 0}
    kept, was = [], False
    for i, x in enumerate(lines):
        was = i in dropped or (was and not x.strip(" \t\n\v\f\r"))
        if not was:
            kept.append(x)
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the later copies taken out of the text, plus ``n_lines`` before and ``n_deleted``."""
    found = materialize(later_copies(docs, id_col, text, min_words), "later")
    n_lines, n_deleted, flag = free_name(docs, "n_lines"), free_name(docs, "n_deleted"), free_name(docs, "_cut")
    key = F.xxhash64(quoted(id_col), F.xxhash64(quoted(text)))
    held = may_hold(docs, key, found.select(F.xxhash64("id", "th").alias("k")), flag)
    whole = F.size(F.split(quoted(text), "\n", -1)).cast("bigint")
    zero = F.when(quoted(text).isNotNull(), F.lit(0)).cast("bigint")
    # Texts without a deleted line are not shuffled; a null text has no lines.
    same = held.where(~quoted(flag)).select(*[quoted(c) for c in docs.columns], F.when(quoted(text).isNotNull(), whole).alias(n_lines), zero.alias(n_deleted))
    runs, by, th = (free_name(docs, x) for x in ("_runs", "_by", "_th"))
    maybe = held.where(quoted(flag)).drop(flag).join(
        found.select(F.col("id").alias(by), F.col("th").alias(th), F.col("runs").alias(runs)),
        quoted(id_col).eqNullSafe(F.col(by)) & (F.xxhash64(quoted(text)) == F.col(th)), "left").drop(by, th)
    names = docs.columns
    schema = T.StructType([*docs.schema.fields]).add(n_lines, "long").add(n_deleted, "long")

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(text)
            cut = [(t, None if t is None else t.count("\n") + 1, None if t is None else 0) if not r or t is None else _cut(t, r)
                   for t, r in zip(b.column(at).to_pylist(), b.column(runs).to_pylist())]
            new, n, gone = zip(*cut) if cut else ((), (), ())
            columns = [pa.array(new, b.schema.field(at).type) if c == text else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=schema.names)

    return same.unionByName(maybe.mapInArrow(run, schema))
