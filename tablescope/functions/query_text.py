"""Query text expressions: normalise, sanitise, keywords, expansion, intent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.rules import INTENT_WORDS, INTENTS, NOISE_WORDS, STOP_WORDS, SYNONYMS


def text_normalize(text: Column) -> Column:
    """Lower case, only a-z 0-9 blanks and hyphens, single blanks."""
    plain = F.regexp_replace(F.lower(text), r"[^a-z0-9\s\-]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def _words(text: Column) -> Column:
    return F.filter(F.split(text_normalize(text), " "), lambda w: F.length(w) > 1)


def _without(words: Column, gone: list[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(gone))


def text_sanitize(text: Column) -> Column:
    """The topic of a query: no noise or stop words; when nothing is left only
    noise words go, and failing that the normalised query itself."""
    words = _words(text)
    strict, loose = _without(words, NOISE_WORDS + STOP_WORDS), _without(words, NOISE_WORDS)
    return (F.when(F.size(strict) > 0, F.array_join(strict, " ")).when(F.size(loose) > 0, F.array_join(loose, " "))
            .otherwise(text_normalize(text)))


def text_keywords(text: Column) -> Column:
    """Keyword array; when nothing is left noise words stay, and failing that the
    first five words."""
    words = _words(text)
    strict, loose = _without(words, NOISE_WORDS + STOP_WORDS), _without(words, STOP_WORDS)
    return F.when(F.size(strict) > 0, strict).when(F.size(loose) > 0, loose).otherwise(F.slice(words, 1, 5))


def query_expand(query: Column, keywords: Column) -> Column:
    """Append up to four synonyms of the domain terms found in the query, in term order."""
    low = F.lower(query)
    table = F.array(*[F.struct(F.lit(t).alias("term"), F.array(*[F.lit(s) for s in two]).alias("two")) for t, two in SYNONYMS.items()])
    found = F.filter(table, lambda e: F.contains(low, e["term"]) | F.array_contains(keywords, e["term"]))
    extra = F.array_distinct(F.flatten(F.transform(found, lambda e: e["two"])))
    new = F.slice(F.filter(extra, lambda s: ~F.contains(low, F.lower(s))), 1, 4)
    return F.when(F.size(new) > 0, F.concat(query, F.lit(" "), F.array_join(new, " "))).otherwise(query)


def query_intent(query: Column) -> Column:
    """Intent of the first known verb in the query, or null."""
    low = F.lower(query)
    return F.coalesce(*[F.when(F.contains(low, F.lit(verb)), F.lit(intent)) for verb, intent in INTENTS.items()])


def intent_score(text: Column, intent: Column) -> Column:
    """80 when the intent itself occurs, else 25 per related word up to 100; 0 without an intent."""
    low = F.lower(text)
    related = F.lit(0)
    for name, words in INTENT_WORDS.items():
        hits = reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in words])
        related = F.when(intent == name, hits).otherwise(related)
    return (F.when(intent.isNull(), 0.0).when(F.contains(low, F.lower(intent)), 80.0)
            .otherwise(F.least(F.lit(100.0), related * 25.0)))
