"""The registered queries of this subpackage: name -> (run, DuckDB text or None)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import ann, bpe, exact_dedup, language, licenses, line_dedup, merkle, minhash, mixing, pii, repeats, resample, toxicity
from .shared import read


#: Only for the registered query; a real key is a secret of whoever runs the operator.
DEMO_KEY = b"tablescope demonstration key"


def _pii(spark, sf_dir):
    return pii.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)


def _language(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(toxicity.fold("doc_id", 4) == 2, F.lit(False))
    model = language.learn(docs.where(toxicity.fold("doc_id", 4) != 2))
    return language.identify(docs.select("doc_id", "text"), model, spans=False).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def _licenses(spark, sf_dir):
    return licenses.scan(read(spark, sf_dir, "documents"))


def _mix(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    m = mixing.mix(docs)
    return m.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
                    (F.col("mix_size") * F.col("mix_repeats")).alias("taken"))


def _bpe(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


def _exact(spark, sf_dir):
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"), digest_all=True)


EXACT_SQL = """
with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents),
     g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by text_sha256)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256 from d join g using (text_sha256)
"""


def _lines(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def _ann(spark, sf_dir):
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def _minhash(spark, sf_dir):
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def _toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = toxicity.fold("doc_id", 5) == 0
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~held)
    return toxicity.scored(docs, model).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _resample(spark, sf_dir):
    return resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def _repeats(spark, sf_dir):
    return repeats.cut_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


def _merkle(spark, sf_dir):
    return merkle.manifest(read(spark, sf_dir, "documents"), merkle.tampered())


QUERIES = {
    "op1_pii": (_pii, None),
    "op2_source_mix": (_mix, None),
    "op3_bpe": (_bpe, None),
    "op4_exact_dedup": (_exact, EXACT_SQL),
    "op5_line_dedup": (_lines, None),
    "op6_language": (_language, None),
    "op7_licenses": (_licenses, licenses.scan_sql()),
    "op8_minhash": (_minhash, None),
    "op9_kmeans_tree": (_ann, None),
    "op10_toxicity": (_toxicity, None),
    "op11_resample": (_resample, resample.resample_sql()),
    "op12_repeats": (_repeats, None),
    "op13_merkle": (_merkle, merkle.manifest_sql()),
}
