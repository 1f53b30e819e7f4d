"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017), with numpy classifiers.

Confirmed toxic texts are the positives; any other text is unlabelled, not negative. The risk of a classifier g is
``p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives))`` with the class prior ``p``: what the unlabelled part owes to hidden
positives is taken off, and never more than there is. Features are the distinct words of a text and their
first letters, hashed.

The fit uses a bounded sample of ids (``positives`` and ``unlabelled`` of them, those with the smallest hash; of
an id's rows one text stands for it); the prior is a count over all
labels of the training part. Scores use every word of every text. Defined results: null and empty texts get the score of a text
without known words; repeated rows score alike; null labels and null ids teach nothing; without a positive the
score is the prior; very long texts are scored whole, in one array of words; empty tables give empty results; a column called score makes the
output column take underscores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import in_parallel
from .kernel import chunks, mix, spans, word_hashes
from .shared import free_name, quoted

BITS = 18
STEM = 5


@dataclass
class Model:
    weights: np.ndarray     # one for each hashed word
    bias: float

    @property
    def known(self) -> np.ndarray:
        return self.weights != 0


def _words(buf, offs) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each word and of each word's first STEM bytes, which its inflections share."""
    starts, ends, first = spans(buf, offs)
    # Punctuation around a word is no part of it.
    plain = np.ones(256, bool)
    plain[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = False
    for _ in range(3):
        trim = (ends > starts) & ~plain[buf[np.maximum(ends - 1, 0)]] if len(buf) else np.zeros(0, bool)
        ends = ends - trim
        trim = (ends > starts) & ~plain[buf[np.minimum(starts, len(buf) - 1)]] if len(buf) else np.zeros(0, bool)
        starts = starts + trim
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    whole = word_hashes(buf, starts, ends)
    stems = mix(word_hashes(buf, starts, np.minimum(ends, starts + STEM)) + np.uint64(1))
    order = np.argsort(np.concatenate([rows, rows]), kind="stable")
    return np.concatenate([rows, rows])[order], (np.concatenate([whole, stems])[order] >> np.uint64(64 - BITS)).astype(np.int64)


def _distinct(rows: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique((rows << BITS) | features)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def train(indptr: np.ndarray, features: np.ndarray, positive: np.ndarray, prior: float, models: int = 3, steps: int = 300,
          min_rows: int = 8, least_z: float = 4.0, least_lift: float = 2.0, rate: float = 0.05, decay: float = 1e-3, seed: int = 7) -> Model:
    """The mean of ``models`` linear classifiers, each fitted to the positives and its own two thirds of the unlabelled rows.

    Words take part that ``min_rows`` rows hold and whose shares among positives and unlabelled rows are ``least_z`` standard errors and
    a factor of ``least_lift`` apart; words of everyday use in one language differ by less.
    """
    size = 1 << BITS
    owner = np.repeat(positive, np.diff(indptr))
    in_p, in_u = (np.bincount(features[owner == x], minlength=size) for x in (True, False))
    share_p, share_u, pooled = in_p / max(1, positive.sum()), in_u / max(1, (~positive).sum()), (in_p + in_u) / max(1, len(positive))
    error = np.sqrt(pooled * (1 - pooled) * (1 / max(1, positive.sum()) + 1 / max(1, (~positive).sum())))
    known = (in_p + in_u >= min_rows) & (np.abs(share_p - share_u) > least_z * np.maximum(error, 1e-12))
    known &= np.abs(np.log((share_p + 1e-4) / (share_u + 1e-4))) > np.log(least_lift)
    number = np.cumsum(known) - 1
    rows = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))[known[features]]
    columns = number[features[known[features]]]
    width, n = int(known.sum()), len(positive)
    total, bias = np.zeros(width), 0.0
    draw = np.random.default_rng(seed)
    unlabelled = np.flatnonzero(~positive)
    for _ in range(models):
        mine = np.zeros(n, bool)
        mine[draw.permutation(unlabelled)[:max(1, len(unlabelled) * 2 // 3)]] = True
        w, c = np.zeros(width), float(np.log(prior / (1 - prior)))
        m, v, mc, vc = np.zeros(width), np.zeros(width), 0.0, 0.0
        n_p, n_u = max(1, positive.sum()), max(1, mine.sum())
        for step in range(1, steps + 1):
            g = np.bincount(rows, w[columns], minlength=n) + c
            s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))      # logistic loss: l+ = -log s, l- = -log(1 - s)
            minus = np.where(mine, -np.log1p(-s + 1e-12), 0).sum() / n_u - prior * np.where(positive, -np.log1p(-s + 1e-12), 0).sum() / n_p
            d_minus = np.where(mine, s / n_u, 0) - prior * np.where(positive, s / n_p, 0)
            d = d_minus * -1.0 if minus < 0 else prior * np.where(positive, (s - 1) / n_p, 0) + d_minus
            dw = np.bincount(columns, d[rows], minlength=width) + decay * w
            dc = d.sum()
            m, v = 0.9 * m + 0.1 * dw, 0.999 * v + 0.001 * dw * dw
            mc, vc = 0.9 * mc + 0.1 * dc, 0.999 * vc + 0.001 * dc * dc
            fix = np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            w -= rate * fix * m / (np.sqrt(v) + 1e-8)
            c -= rate * fix * mc / (np.sqrt(vc) + 1e-8)
        total += w / models
        bias += c / models
    weights = np.zeros(size, np.float32)
    weights[known] = total
    return Model(weights, bias)


def fit(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
        positives: int = 2000, unlabelled: int = 8000) -> Model:
    """Fit from ``labels`` (id, label) and ``docs``, both where ``training`` (a condition on the id column) holds. At most
    ``positives + unlabelled`` rows come to the driver, as hashed words."""
    order = F.xxhash64(F.lit("fit"), F.col("id"))
    mine = labels.where(training).where(quoted(label).isNotNull() & quoted(id_col).isNotNull())
    sample = lambda ids, n: ids.select(quoted(id_col).alias("id")).orderBy(order, "id").limit(n)     # noqa: E731
    (prior, count), chosen, others = in_parallel(
        docs.sparkSession,
        lambda: mine.agg(F.avg((quoted(label) == 1).cast("double")), F.count(F.when(quoted(label) == 1, 1))).first(),
        lambda: {r[0] for r in sample(mine.where(quoted(label) == 1).dropDuplicates([id_col]), positives).collect()},
        lambda: {r[0] for r in sample(docs.where(training).where(quoted(id_col).isNotNull()).select(quoted(id_col)).distinct(), unlabelled).collect()})
    prior = min(0.9, max(1e-4, prior or 0.0))
    if not count:
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(prior / (1 - prior))))
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    ids = spark.createDataFrame([(i, i in chosen) for i in sorted(chosen | others)], T.StructType().add("id", kind).add("confirmed", "boolean"))

    def features(batches):
        for b in batches:
            lists: list[np.ndarray] = []
            for _, _, buf, offs in chunks(b.column("text")):
                rows, f = _distinct(*_words(buf, offs))
                lists += np.split(f.astype(np.int32), np.searchsorted(rows, np.arange(1, len(offs) - 1)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("confirmed"), pa.array(lists, pa.list_(pa.int32()))],
                                             names=["id", "confirmed", "words"])

    few = docs.select(quoted(id_col).alias("id"), quoted(text).alias("text")).join(F.broadcast(ids), "id")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")      # a row for each sampled id, however many it has
    few = few.groupBy("id", "confirmed").agg(one).select("id", "confirmed", "one.text")
    rows = few.mapInArrow(features, T.StructType().add("id", kind).add("confirmed", "boolean").add("words", T.ArrayType(T.IntegerType()))).toArrow()
    rows = rows.sort_by("id").combine_chunks()
    words = rows.column("words").combine_chunks()
    flat, lengths = np.asarray(words.flatten(), np.int64), np.asarray(words.value_lengths(), np.int64)
    confirmed = np.asarray(rows.column("confirmed").combine_chunks(), bool)
    return train(np.concatenate([[0], np.cumsum(lengths)]), flat, confirmed, prior)


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score", keep_text: bool = False) -> DataFrame:
    """``docs`` (without its text unless ``keep_text``) plus ``name``, from 0 to 1; where ``docs`` has such a column, with underscores in front."""
    name = free_name(docs, name)
    kept = [c for c in docs.columns if keep_text or c != text]
    schema = T.StructType([docs.schema[c] for c in kept]).add(name, "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)       # 1 MB

    def run(batches):
        m = shared.value
        known = m.known
        for b in batches:
            out = np.empty(b.num_rows)
            at = b.schema.get_field_index(text)
            for a, e, buf, offs in chunks(b.column(at)):
                rows, f = _words(buf, offs)
                rows, f = _distinct(rows[known[f]], f[known[f]])
                g = np.bincount(rows, m.weights[f], minlength=e - a) + m.bias
                out[a:e] = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(b.num_columns) if keep_text or i != at] + [pa.array(out)], names=schema.names)

    return docs.mapInArrow(run, schema)


def fold(id_col: str, parts: int) -> Column:
    """The fold of a row by the CRC-32 of its id as text; null for a null id."""
    return F.crc32(quoted(id_col).cast("string").cast("binary")) % parts
