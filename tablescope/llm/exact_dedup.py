"""Exact duplicates by progressive refinement, in DataFrame operations only.

Rows are grouped by length, groups of two or more by a hash of their first characters, and only what is still together has its whole
text hashed (SHA-256). The keys that survive a level travel as a bitmap of bounded size, so no text is shuffled.

Texts are equal when identical after lower-casing A-Z. Defined results: a null text counts as empty; of equal texts the row with
the largest id stays, and rows that repeat that id stay with it, as they are one document; null ids lose to any id, and a group of
null ids only keeps all of them; an empty table gives an empty result; very long texts are hashed where they are read; only the id and text
columns are read, so further columns change nothing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .shared import may_hold, quoted

PREFIX = 64     # characters in the hash of the second level
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", digest_all: bool = False) -> DataFrame:
    """(id, keep_id, group_size, kept), one row for each row of ``docs``; with ``digest_all`` also ``text_sha256`` of every text,
    which rows that the cheaper levels settle need for this output alone."""
    body = F.coalesce(quoted(text), F.lit(""))
    length, start = F.octet_length(body), F.xxhash64(folded(F.substring(body, 1, PREFIX)))
    heads = materialize(docs.select(length.alias("length"), start.alias("start")).groupBy("length", "start").agg(F.count("*").alias("n")), "heads")
    shared_length = heads.groupBy("length").agg(F.sum("n").alias("rows")).where("rows > 1").select("length")
    shared_start = heads.where("n > 1").join(shared_length, "length", "left_semi").select(F.xxhash64("length", "start").alias("k"))
    rows = may_hold(docs.select(quoted(id_col).alias("_id"), body.alias("_body")), F.xxhash64(F.octet_length("_body"), F.xxhash64(folded(F.substring("_body", 1, PREFIX)))),
                    shared_start, "_together")
    whole = F.sha2(folded(F.col("_body")), 256)
    if digest_all:
        hashed = rows.select("_id", "_together", whole.alias("_digest"))
    else:
        hashed = rows.select("_id", "_together", F.when(F.col("_together"), whole).alias("_digest"))
    hashed = materialize(hashed, "digests")
    last = ["_digest"] if digest_all else []
    alone = hashed.where(~F.col("_together")).select("_id", F.col("_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
                                                     F.lit(True).alias("kept"), *last)
    groups = hashed.where("_together").groupBy(F.col("_digest").alias("_d")).agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size"))
    # A single row per text on the right, written before the join: only then is a hot text on the left split by adaptive execution.
    groups = materialize(groups, "groups")
    several = hashed.where("_together").join(groups, F.col("_digest") == F.col("_d")).select(
        "_id", "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), *last)
    out = alone.unionByName(several).withColumnRenamed("_id", id_col)
    return out.withColumnRenamed("_digest", "text_sha256") if digest_all else out
