"""Skewness transforms: log, square root, Box-Cox, Yeo-Johnson.

The Box-Cox and Yeo-Johnson exponents maximise a likelihood that is a function
of plain sums, so a grid of exponents for every column is evaluated by one
aggregate and the grid is then narrowed around the best one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import fold_nan, numeric_columns, quoted, replace_columns
from .stats import ColumnStats, column_stats

_GRID = 25


def boxcox(log_x: Column, lam: float) -> Column:
    """Box-Cox of x from ln x."""
    return log_x if abs(lam) < 1e-12 else F.expm1(log_x * lam) / lam


def yeojohnson(log_x: Column, lam: float) -> Column:
    """Yeo-Johnson of x from sign(x) * ln(1 + |x|)."""
    mu = 2.0 - lam
    up = log_x if abs(lam) < 1e-12 else F.expm1(log_x * lam) / lam
    down = log_x if abs(mu) < 1e-12 else -F.expm1(-log_x * mu) / mu
    return F.when(log_x >= 0, up).otherwise(down)


def _logs(x: Column, method: str) -> Column:
    return F.log(x) if method == "box_cox" else F.signum(x) * F.log1p(F.abs(x))


def best_exponents(df: DataFrame, columns: list[str], method: str, tol: float = 1e-5) -> dict[str, float]:
    """Maximum-likelihood exponent per column."""
    transform = boxcox if method == "box_cox" else yeojohnson
    data = df.select([_logs(quoted(c).cast("double"), method).alias(f"l{i}") for i, c in enumerate(columns)])
    middle = dict.fromkeys(range(len(columns)), 0.0)
    span = dict.fromkeys(range(len(columns)), 5.0)
    while True:
        todo = [i for i in middle if span[i] > tol]
        if not todo:
            return {c: middle[i] for i, c in enumerate(columns)}
        grids = {i: [middle[i] + span[i] * (2 * j / (_GRID - 1) - 1) for j in range(_GRID)] for i in todo}
        aggs = []
        for i in todo:
            x = F.col(f"l{i}")
            aggs += [F.count(x).alias(f"n{i}"), F.sum(x).alias(f"s{i}")]
            aggs += [F.var_pop(transform(x, lam)).alias(f"v{i}_{j}") for j, lam in enumerate(grids[i])]
        row = data.agg(*aggs).first()
        for i in todo:
            def score(j):
                var = row[f"v{i}_{j}"]
                if var is None or not math.isfinite(var) or var <= 0:
                    return -math.inf
                return (grids[i][j] - 1) * row[f"s{i}"] - row[f"n{i}"] / 2 * math.log(var)

            best = max(range(_GRID), key=score)
            middle[i] = grids[i][best]
            if 0 < best < _GRID - 1 or abs(middle[i]) > 50:      # otherwise move the grid instead of narrowing it
                span[i] = 2 * span[i] / (_GRID - 1)


def skewed_columns(df: DataFrame, columns: list[str] | None = None) -> tuple[list[str], ColumnStats]:
    """Numeric columns with at least ten values and |skewness| above 1."""
    numeric = numeric_columns(df)
    numeric = [c for c in columns if c in numeric] if columns else numeric
    stats = column_stats(df, numeric, ("skew", "min"), numeric)
    return [c for c in numeric if stats.count[c] >= 10 and abs(stats.get(c, "skew") or 0.0) > 1], stats


def apply_exponents(df: DataFrame, exponents: dict[str, float], method: str) -> DataFrame:
    """Transform columns with known exponents; Yeo-Johnson results are
    standardised to mean 0 and population deviation 1."""
    form = boxcox if method == "box_cox" else yeojohnson
    raw = {c: form(_logs(quoted(c).cast("double"), method), lam) for c, lam in exponents.items()}
    if method == "box_cox" or not raw:
        return replace_columns(df, raw)
    moments = column_stats(replace_columns(df, raw), list(raw), ("mean", "std_pop"), [])
    return replace_columns(df, {c: (t - F.lit(moments.get(c, "mean"))) / F.lit(moments.get(c, "std_pop") or 1.0) for c, t in raw.items()})


def handle_skewness(df: DataFrame, method: str = "yeo_johnson", columns: list[str] | None = None) -> DataFrame:
    """Transform the skewed columns; those a method cannot take stay as they are."""
    df = fold_nan(df)
    if method not in ("log", "sqrt", "box_cox", "yeo_johnson"):
        return df
    skewed, stats = skewed_columns(df, columns)
    x = lambda c: quoted(c).cast("double")
    if method == "log":
        return replace_columns(df, {c: F.log1p(x(c)) for c in skewed if stats.get(c, "min") > 0})
    if method == "sqrt":
        return replace_columns(df, {c: F.sqrt(x(c)) for c in skewed if stats.get(c, "min") >= 0})
    if method == "box_cox":
        skewed = [c for c in skewed if stats.get(c, "min") > 0]
    return apply_exponents(df, best_exponents(df, skewed, method), method) if skewed else df
