"""Languages of texts, by spans: script ranges narrow the candidates of each word, and a Viterbi path over per-word scores with a
penalty for switching labels the spans of mixed texts.

A word is a run of letters. Its score in a language is the sum, over its letters, of the log probability of the letter with both
neighbours (word ends count as a neighbour), from counts over all training texts. A language is a candidate for a word if it uses the
word's script: at least SCRIPT_SHARE of its training letters are in it. The label of a text is the language of most letters; the score
is its share of the letters.

Counts come from every training row (a task adds up its rows, Spark sums by language and feature); the model, at most 2^BITS
numbers a language, is broadcast. Defined results: a text that is null or has no letter is ``und`` with score 0; ties go to the
smaller label; without training rows every text is ``und``; repeated rows are labelled alike; whole texts of any length count; an empty
table gives an empty result; columns called lang_pred, score or spans make the output columns take underscores.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, quoted

BITS = 16
SMOOTHING = 0.5
SWITCH = 12.0           # in nats
SCRIPT_SHARE = 0.01
PORTION = 2 << 20       # characters whose words are scored together

# Where the letters of a script lie in Unicode (first, last code point). 0 is any other script.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF),
    ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F),
    ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF),
    ("ethiopic", 0x1200, 0x137F), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("han", 0x20000, 0x3FFFF),
]
NAMES = ["other", *dict.fromkeys(n for n, _, _ in SCRIPTS)]
_tables: dict[str, np.ndarray] = {}


def _script_of() -> np.ndarray:
    """By code point: 0 no letter, else 1 + the script's number."""
    if "script" not in _tables:
        t = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), np.uint8, 0x110000)
        for name, a, b in SCRIPTS:
            t[a:b + 1] *= 1 + NAMES.index(name)
        _tables["script"] = t
    return _tables["script"]


def _portions(texts: list[str]):
    """(first, end) rows of about PORTION characters."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > PORTION:
            yield first, i
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield first, len(texts)


def _letters(texts: list[str]):
    """(script, feature, row, begins) of each letter, texts in a row; begins: the letter opens a word."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered))
    script = _script_of()[points]
    at = np.flatnonzero(script)
    plain = np.where(script > 0, points, np.uint32(32))
    feature = plain[at - 1] * np.uint32(0x9E3779B1) + plain[at] * np.uint32(0x85EBCA77) + plain[at + 1] * np.uint32(0xC2B2AE3D)
    feature ^= feature >> np.uint32(15)
    feature *= np.uint32(0x2C1B3C6D)
    rows = np.searchsorted(np.cumsum(sizes), at - 1, "right")
    return script[at].astype(np.int64) - 1, (feature >> np.uint32(32 - BITS)).astype(np.int64), rows, script[at - 1] == 0


@dataclass
class Model:
    langs: list[str]
    logs: np.ndarray        # feature x language
    uses: np.ndarray        # script x language


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts over all rows of ``docs`` whose language is not null."""
    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            texts = [x or "" for x in b.column("text").to_pylist()]
            langs = np.array(b.column("lang").to_pylist(), object)
            for a, e in _portions(texts):
                script, feature, rows, _ = _letters(texts[a:e])
                codes, names = np.unique(langs[a:e].astype(str), return_inverse=True)
                key = names[rows]
                for i, name in enumerate(codes):
                    mine = key == i
                    both = np.concatenate([np.bincount(feature[mine], minlength=1 << BITS), np.bincount(script[mine], minlength=len(NAMES))])
                    total[name] = total[name] + both if name in total else both
        for name, both in total.items():
            some = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(some)), pa.array(some.astype(np.int32)), pa.array(both[some], pa.int64())],
                                             names=["lang", "feature", "n"])

    known = docs.where(quoted(lang).isNotNull()).select(quoted(text).alias("text"), quoted(lang).cast("string").alias("lang"))
    sums = known.mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(sums.column("lang").to_pylist()))
    table = np.zeros(((1 << BITS) + len(NAMES), len(langs)))
    if langs:
        which = np.searchsorted(np.array(langs, object), np.array(sums.column("lang").to_pylist(), object))
        table[np.asarray(sums.column("feature")), which] = np.asarray(sums.column("n"))
    counts, scripts = table[:1 << BITS], table[1 << BITS:]
    seen = max(1, int((counts.sum(axis=1) > 0).sum()))
    logs = np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * seen))
    return Model(langs, logs.astype(np.float32), scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1))


def best_path(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The label of each word on the best path of its text; text i has the words first[i]:first[i + 1]. All texts go side by side, one
    word each at a time, longest first."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = first[:-1][order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), "left")       # texts with a word at each place
    stay = np.zeros(scores.shape, bool)
    source = np.zeros(len(scores), np.int8 if scores.shape[1] < 128 else np.int32)
    v = scores[begin[:active[0]]].copy() if longest else scores[:0]
    end = np.zeros(len(order), np.int64)
    for t in range(1, longest + 1):
        m = active[t] if t < longest else 0
        end[m:len(v)] = v[m:].argmax(axis=1)
        v = v[:m]
        if not m:
            break
        at = begin[:m] + t
        best = v.argmax(axis=1)
        moved = v[np.arange(m), best] - penalty
        keeps = v >= moved[:, None]
        stay[at], source[at] = keeps, best
        v = np.where(keeps, v, moved[:, None]) + scores[at]
    labels = np.zeros(len(scores), np.int64)
    now = np.zeros(len(order), np.int64)
    for t in range(longest - 1, -1, -1):
        m = active[t]
        fresh = active[t + 1] if t + 1 < longest else 0
        now[fresh:m] = end[fresh:m]
        at = begin[:m] + t
        labels[at] = now[:m]
        if t:
            now[:m] = np.where(stay[at, now[:m]], now[:m], source[at])
    return labels


def _label(model: Model, texts: list[str]):
    """(row, label, letters) of each word, and the number of words of each text."""
    script, feature, rows, begins = _letters(texts)
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    scores = np.add.reduceat(model.logs[feature], starts, axis=0)
    may = model.uses[script[starts]]
    narrowed = may.any(axis=1)[:, None] & ~may
    scores = np.where(narrowed, -1e6, scores - scores.max(axis=1, keepdims=True)).astype(np.float32)
    of = rows[starts]
    first = np.searchsorted(of, np.arange(len(texts) + 1))
    return of, best_path(scores, first, SWITCH), np.diff(np.append(starts, len(feature)))


def identify(docs: DataFrame, model: Model, text: str = "text", spans: bool = True) -> DataFrame:
    """``docs`` without the text, plus lang_pred, score and, with ``spans``, the spans: array<struct<lang, words, letters>> in order."""
    kept = [c for c in docs.columns if c != text]
    schema = T.StructType([docs.schema[c] for c in kept]).add(free_name(docs, "lang_pred"), "string").add(free_name(docs, "score"), "double")
    if spans:
        schema.add(free_name(docs, "spans"), T.ArrayType(T.StructType().add("lang", "string").add("words", "integer").add("letters", "integer")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        names = np.array([*m.langs, "und"], object)
        for b in batches:
            at = b.schema.get_field_index(text)
            texts = [x or "" for x in b.column(at).to_pylist()]
            pred, score, found = [], [], []
            for a, e in _portions(texts):
                n, k = e - a, max(1, len(m.langs))
                row, label, letters = _label(m, texts[a:e]) if m.langs else (np.zeros(0, np.int64),) * 3
                per = np.bincount(row * k + label, letters, n * k).reshape(n, k)
                total = per.sum(axis=1)
                pred.append(np.where(total > 0, per.argmax(axis=1), len(m.langs)))
                score.append(per.max(axis=1) / np.maximum(total, 1))
                if spans:
                    new = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(label, prepend=-1)) if len(row) else np.zeros(0, np.int64)
                    words = np.diff(np.append(new, len(row)))
                    size = np.add.reduceat(letters, new) if len(new) else new
                    lists = [[] for _ in range(n)]
                    for i, lang, w, s in zip(row[new].tolist(), label[new].tolist(), words.tolist(), size.tolist()):
                        lists[i].append({"lang": m.langs[lang], "words": w, "letters": s})
                    found += lists
            columns = [b.column(i) for i in range(b.num_columns) if i != at]
            columns += [pa.array(names[np.concatenate(pred)] if pred else [], pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64())]
            if spans:
                columns.append(pa.array(found, pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32()), ("letters", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)
