"""Ordered cleaning steps over one table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators.cleaning import drop_low_variance, normalize, remove_correlated, remove_duplicates, remove_outliers
from ..operators.encode import encode_categorical
from ..operators.missing import handle_missing
from ..operators.power import handle_skewness
from ..operators.profile import EmptyTableError, Profile, empty_profile, profile
from ..session import local_table, materialize

# Action name -> (operator, parameters it takes).
ACTIONS = {
    "handle_missing": (handle_missing, ("strategy", "threshold", "n_neighbors", "max_iter")),
    "remove_duplicates": (remove_duplicates, ()),
    "remove_correlated": (remove_correlated, ("threshold",)),
    "handle_skewness": (handle_skewness, ("method", "columns")),
    "normalize": (normalize, ("method", "columns")),
    "remove_outliers": (remove_outliers, ("method", "threshold", "joint")),
    "encode_categorical": (encode_categorical, ("method", "max_categories")),
    "drop_low_variance": (drop_low_variance, ("threshold",)),
}

REPORT = ("dataset_id string, applied_steps array<string>, rows_removed bigint, columns_removed int, columns_added int, summary string")


@dataclass
class PrepResult:
    table: DataFrame
    before: Profile
    after: Profile
    applied: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    report: DataFrame | None = None


def _is_wide(action: str, params: dict) -> bool:
    """Whether a step shuffles or runs Python, so that repeating it costs more than storing its result."""
    if action == "handle_missing":
        return params.get("strategy", "smart") not in ("drop_rows", "drop_cols", "mean", "median", "mode")
    return action in ("remove_duplicates", "encode_categorical")


def apply_steps(df: DataFrame, steps: list[dict]) -> tuple[DataFrame, list[str], list[str]]:
    """(table, applied actions, notes).

    ``steps`` is a list of ``{"action": ..., "params": {...}}``. A step that
    fails is noted and skipped; unknown actions are ignored. Steps that are plain
    projections or filters stay lazy; after the others the table is written once
    to the shared folder, because the next steps learn their parameters from it
    several times.
    """
    applied, notes = [], []
    for step in steps:
        action, params = step.get("action"), step.get("params") or {}
        if action not in ACTIONS:
            continue
        run, names = ACTIONS[action]
        try:
            out = run(df, **{k: v for k, v in params.items() if k in names})
            df = materialize(out, "step") if _is_wide(action, params) else out
        except Exception as problem:        # the contract: report, skip, go on
            notes.append(f"{action}: failed ({type(problem).__name__})")
            continue
        applied.append(action)
        notes.append(f"{action}: done")
    return df, applied, notes


def run_steps(df: DataFrame, steps: list[dict], dataset_id: str = "table") -> PrepResult:
    """Clean a table step by step, with a profile before and after and a report."""
    spark = df.sparkSession
    out, applied, notes = apply_steps(df, steps)

    def look(table):
        try:
            return profile(table, dataset_id)
        except EmptyTableError:
            return empty_profile(spark)

    before, after = look(df), look(out)
    gone = len(df.columns) - len(out.columns)
    report = local_table(spark, [{
        "dataset_id": dataset_id, "applied_steps": applied, "rows_removed": df.count() - out.count(),
        "columns_removed": max(0, gone), "columns_added": max(0, -gone), "summary": "; ".join(notes) or "No changes applied."}], REPORT)
    return PrepResult(out, before, after, applied, notes, report)
