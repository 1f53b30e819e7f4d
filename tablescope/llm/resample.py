"""Importance resampling towards a target distribution, by hashed word runs.

Every run of 1 to ``longest`` words counts into a bucket by its CRC-32. Two arrays of ``buckets`` counts, of the corpus and of the target texts,
give each bucket a gain, the logarithm of the ratio of its shares; a text's weight is the sum of the gains of its runs, and its score the weight
plus Gumbel noise, so that the highest scores are a sample without replacement in proportion to exp(weight).

The cutoff is found by weighted median-of-medians. Every partition reports the median of its remaining keys; the median of these, weighted by the
sizes they stand for, has at least a quarter of all remaining keys on either side. One pass counts the keys above it and reports the
medians of both sides, one side is discarded, and so on until the pivot is the wanted key. Only winners are sorted. The driver sees a row for each
partition; the remainder is written anew whenever it is an eighth of what was written last, so all passes together read a small multiple of the keys.

Gains round down to thousandths; they and the noise are computed in doubles. Defined results: null and empty texts have no runs, weight 0 and take
part only if ``min_words`` is 0; long texts are read whole, in pieces of words; null ids are noised as the empty text and rank last among equal scores; equal
scores rank by id, and rows that repeat an id by their text's hash, so repeated rows are drawn one by one; an empty table gives an empty result and an
empty target gives weights that favour the corpus's rare buckets; only the id and text columns are read, so further columns change nothing.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import in_parallel, materialize
from .kernel import chunks
from .shared import dense_ranks, quoted

BUCKETS = 10_000
SHORT = 48      # bytes of a word that are hashed side by side with others

#: 0-9, A-Z (as a-z), a-z and every byte of a character beyond ASCII make words.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def _continue(crc: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of what ``crc`` stands for, followed by each word."""
    state = ~crc
    size = ends - starts
    order = np.argsort(np.minimum(size, 255).astype(np.uint8), kind="stable")
    sorted_size = size[order]
    short = order[:np.searchsorted(sorted_size, SHORT, "right")]
    at, size_of = starts[short], sorted_size[:len(short)]
    s = state[short]
    for t in range(int(size_of[-1]) if len(short) else 0):
        a = np.searchsorted(size_of, t, "right")
        s[a:] = _CRC[(s[a:] ^ buf[at[a:] + t]) & np.uint32(0xFF)] ^ (s[a:] >> np.uint32(8))
    state[short] = s
    out = ~state
    for i in order[len(short):]:
        out[i] = zlib.crc32(buf[starts[i]:ends[i]], int(crc[i]))
    return out


def features(texts: pa.Array, longest: int, buckets: int):
    """(first row, rows, words of each row, row of each run, bucket of each run) over chunks of the column."""
    for first, end, raw, offs in chunks(texts):
        buf = FOLD[raw]
        inside = np.concatenate([[False], WORD[buf], [False]])
        starts, ends = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
        if len(offs) > 2:       # words stop at the ends of texts
            edges = offs[1:-1]
            edges = np.unique(edges[(edges > 0) & (edges < len(buf))])
            cut = edges[inside[edges] & inside[edges + 1]]
            starts, ends = np.union1d(starts, cut), np.union1d(ends, cut)
        row = np.searchsorted(offs, starts, "right") - 1
        crc = _continue(np.zeros(len(starts), np.uint32), buf, starts, ends)
        rows, runs = [row], [crc]
        for more in range(1, longest):
            same = row[more:] == row[:-more] if len(row) > more else np.zeros(0, bool)
            here = np.flatnonzero(same)
            crc = crc[here] if more == 1 else crc[np.isin(held, here)]
            held = here
            blank = _CRC[(~crc ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (~crc >> np.uint32(8))
            crc = _continue(~blank, buf, starts[here + more], ends[here + more])
            rows.append(row[here])
            runs.append(crc)
        yield first, end - first, np.bincount(row, minlength=end - first), np.concatenate(rows), (np.concatenate(runs) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How often each bucket occurs in the single text column of ``texts``: one array for each task, added up."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for *_, of in features(b.column(0), longest, buckets):
                total += np.bincount(of, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    rows = texts.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()     # ``buckets`` rows at most
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    k, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _noise(key: str | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{key or ''}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text: str = "text", longest: int = 1, seed: int = 2024) -> DataFrame:
    """(id, n_words, n_features, weight, score, tie) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)     # 8 bytes a bucket
    rows = docs.select(quoted(id_col).alias("id"), quoted(id_col).cast("string").alias("key"), F.xxhash64(quoted(text)).alias("tie"), quoted(text).alias("text"))

    def run(batches):
        g = shared.value
        for b in batches:
            words, count, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for first, n, of_row, row, bucket in features(b.column("text"), longest, len(g)):
                words[first:first + n] = of_row
                count[first:first + n] = np.bincount(row, minlength=n)
                weight[first:first + n] = np.bincount(row, g[bucket], minlength=n).astype(np.int64)      # whole numbers below 2^53
            noise = np.fromiter((_noise(k, seed) for k in b.column("key").to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), *map(pa.array, (words, count, weight, weight + noise)), b.column("tie")],
                                             names=["id", "n_words", "n_features", "weight", "score", "tie"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, weight bigint, score bigint, tie bigint")


# -- selection

_ORDER = ["down", "no_id", "id", "tie"]


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("down", -F.col("score")).withColumn("no_id", F.col("id").isNull())


def _before(row: dict) -> Column:
    """Keys that stand before that of ``row``; equal ones do not."""
    less, same = F.lit(False), F.lit(True)
    for c in _ORDER:
        if row[c] is None:
            continue        # a null id equals null ids only, and no_id has told these apart
        less = less | (same & (F.col(c) < F.lit(row[c])))
        same = same & F.col(c).eqNullSafe(F.lit(row[c]))
    return F.coalesce(less, F.lit(False))


def _same(row: dict) -> Column:
    out = F.lit(True)
    for c in _ORDER:
        out = out & F.col(c).eqNullSafe(F.lit(row[c]))
    return out


def _medians(rows: DataFrame) -> list[dict]:
    """Per partition and side: how many keys remain there and their median. ``side`` is -1 before, 0 at, 1 after the last pivot."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        batches = list(batches)         # four narrow columns of one partition
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        for side in (-1, 0, 1):
            part = table.filter(pc.equal(table.column("side"), side))
            if part.num_rows:
                mid = part.take(pc.sort_indices(part, [(c, "ascending") for c in _ORDER])[(part.num_rows - 1) // 2:][:1])
                yield pa.RecordBatch.from_arrays([pa.array([side], pa.int32()), pa.array([part.num_rows]), *[mid.column(c).combine_chunks() for c in _ORDER]],
                                                 names=["side", "n", *_ORDER])

    found = rows.select(F.col("side").cast("int").alias("side"), *_ORDER).mapInArrow(run, f"side int, n bigint, down bigint, no_id boolean, id {kind}, tie bigint")
    return [r.asDict() for r in found.collect()]


def _weighted_median(medians: list[dict]) -> dict:
    ordered = sorted(medians, key=lambda r: (r["down"], r["no_id"], *([] if r["no_id"] else [r["id"]]), r["tie"]))
    half, seen = sum(r["n"] for r in ordered) / 2, 0
    for r in ordered:
        seen += r["n"]
        if seen >= half:
            return r
    raise ValueError("no keys")


def cutoff(rows: DataFrame, k: int) -> dict:
    """The key at place ``k`` (from 1) of the order of ``rows`` (down, no_id, id, tie)."""
    table = rows.select(*_ORDER)
    found = _medians(table.withColumn("side", F.lit(1)))
    left = written = sum(r["n"] for r in found)
    bound = F.lit(True)
    while True:
        pivot = _weighted_median(found)
        before, same = _before(pivot), _same(pivot)
        found = _medians(table.where(bound).withColumn("side", F.when(before, -1).when(same, 0).otherwise(1)))
        n = {s: sum(r["n"] for r in found if r["side"] == s) for s in (-1, 0, 1)}
        if n[-1] < k <= n[-1] + n[0]:
            return pivot
        side = -1 if k <= n[-1] else 1
        bound = bound & (before if side < 0 else ~before & ~same)
        k -= 0 if side < 0 else n[-1] + n[0]
        left, found = n[side], [r for r in found if r["side"] == side]
        if 8 * left <= written:
            table, written, bound = materialize(table.where(bound), "remaining"), left, F.lit(True)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, id_col: str = "doc_id", text: str = "text",
             target_text: str = "text", longest: int = 1, buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """(id, n_features, weight, score, rank), one row for each row of ``docs``. Of those with ``min_words`` words or more, ``percent`` in a hundred
    (rounded down) are drawn; ``rank`` is null for the others."""
    s, t = in_parallel(docs.sparkSession, lambda: bucket_counts(docs.select(quoted(text)), longest, buckets),
                       lambda: bucket_counts(target.select(quoted(target_text)), longest, buckets))
    rows = _keyed(materialize(scores(docs, gains(s, t), id_col, text, longest, seed), "scores"))
    fit = F.col("n_words") >= min_words
    k = percent * rows.where(fit).count() // 100
    out = lambda df, rank: df.select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.cast("bigint").alias("rank"))
    if not k:
        return out(rows, F.lit(None))
    last = cutoff(rows.where(fit), k)
    wins = fit & (_before(last) | _same(last))
    ranked = dense_ranks(rows.where(wins), _ORDER, "winners")
    # Rows that repeat the last key may be one too many; the order numbers them, and those beyond k are not drawn.
    drawn = F.when(F.col("rank") <= k, F.col("rank"))
    return out(ranked, drawn).unionByName(out(rows.where(~wins), F.lit(None)))


def resample_sql(buckets: int = BUCKETS, percent: int = 10, min_words: int = 20, seed: int = 2024) -> str:
    """The same rows as DuckDB SQL, for runs of one word. CRC-32 is computed bit by bit, once for each distinct word."""
    return f"""
with recursive bits as (select i::ubigint as i, i::ubigint as c, 0 as k from range(256) t(i)
                        union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end, k + 1 from bits where k < 8),
table_of as (select list(c order by i) as t from bits where k = 8),
words_of as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as w from documents),
words_in as (select unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as w from benchmark),
dictionary as (select w, xor(list_reduce(list_prepend(4294967295::ubigint, [('0x' || hex(encode(w))[2 * j - 1:2 * j])::ubigint for j in range(1, octet_length(encode(w)) + 1)]),
                     lambda c, b: xor(t[((xor(c, b) & 255) + 1)::bigint], c >> 8)), 4294967295::ubigint) % {buckets} as b
               from (select w from words_of union select w from words_in), table_of),
s as (select b, count(*) as s from words_of join dictionary using (w) group by b),
t as (select b, count(*) as t from words_in join dictionary using (w) group by b),
totals as (select (select coalesce(sum(s), 0) from s) as s_all, (select coalesce(sum(t), 0) from t) as t_all),
gain as (select s.b, floor(1000 * ln((coalesce(t, 0) + 1)::double * (s_all + {buckets}) / ((s + 1)::double * (t_all + {buckets}))))::bigint as g
         from s left join t using (b), totals),
weights as (select doc_id, count(*) as n, sum(g)::bigint as weight from words_of join dictionary using (w) join gain using (b) group by doc_id),
scored as (select doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
                  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{seed}:' || doc_id)[1:8])::bigint + 0.5) / 4294967296))))::bigint as score
           from documents left join weights using (doc_id)),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) as rank from scored where n_features >= {min_words})
select doc_id, n_features, weight, score, case when rank <= (select {percent} * count(*) // 100 from ranked) then rank end as rank
from scored left join ranked using (doc_id)
"""
