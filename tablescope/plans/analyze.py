"""Analyse one or many tables: profile, score, insights, advice, bias, next steps."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..operators.profile import Profile, drop_empty, preview, profile
from ..session import in_parallel
from .bias import bias_warnings, numeric_figures
from .insights import insights
from .next_steps import next_steps
from .recommend import column_roles, recommend, text_facts
from .score import overall_score, quality_score

TABLES_AT_ONCE = 4


@dataclass
class Analysis:
    profile: Profile
    roles: DataFrame
    score_components: DataFrame
    score: DataFrame
    insights: DataFrame
    recommendation: DataFrame
    bias_warnings: DataFrame
    next_steps: DataFrame


def previews(tables: dict[str, DataFrame], n: int = 20) -> dict[str, DataFrame]:
    """The first rows of every analysed table, in the order of their columns, ready for JSON."""
    kept = {name: drop_empty(df) for name, df in tables.items()}
    return {name: preview(df, n, [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]) for name, df in kept.items()}


def analyze(tables: dict[str, DataFrame], approx: bool = False, digest: bool = False) -> Analysis:
    """Every judgement of every table, keyed by ``dataset_id``.

    One set of rules runs over the union of the small profile tables, however
    many tables are given. With ``digest`` texts are counted by their SHA-256, so that long ones are not shuffled.
    """
    def one(dataset_id: str, df: DataFrame) -> tuple[Profile, DataFrame, DataFrame]:
        df = drop_empty(df)
        found, figures, facts = in_parallel(
            df.sparkSession, lambda: profile(df, dataset_id, approx, digest=digest), lambda: numeric_figures(df),
            lambda: text_facts(df, digest))
        uniques = {r["name"]: r["unique_count"] for r in found.columns.collect()}       # one row per column
        roles = column_roles(df, dataset_id, uniques, found.metrics.first()["rows"], facts)
        target = recommend(roles).first()["target"]
        return found, roles, bias_warnings(df, dataset_id, target, figures)

    if not tables:
        raise ValueError("no tables given")
    items, done = list(tables.items()), []
    for i in range(0, len(items), TABLES_AT_ONCE):
        jobs = [lambda name=name, df=df: one(name, df) for name, df in items[i:i + TABLES_AT_ONCE]]
        done += in_parallel(items[0][1].sparkSession, *jobs)
    profiles = reduce(Profile.union, [d[0] for d in done])
    roles, warned = (reduce(DataFrame.unionByName, [d[k] for d in done]) for k in (1, 2))
    found, advice = insights(profiles), recommend(roles)
    return Analysis(profiles, roles, quality_score(profiles), overall_score(profiles), found, advice, warned,
                    next_steps(profiles, found, warned, advice))
