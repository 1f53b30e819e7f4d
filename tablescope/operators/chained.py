"""Chained-equation imputation from sufficient statistics.

Every column update is a Bayesian ridge regression, which needs only counts,
sums and cross-products. In rows that lack the same columns a filled value is an
affine function of the known ones, so the moments of all rows after any number of
updates follow from the moments of the known values by pattern of gaps. One
pass over the table collects these; complete rows are one pattern, counted once and for all.

A round then works on the patterns: a small matrix product each, on the driver
if they are few, else in tasks. Only the largest change of a row needs rows again: one
pass for each round over the rows with gaps, which replays the affine maps of the rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import fold_nan, numeric_columns, quoted, replace_columns
from ..session import materialize
from .stats import column_stats

MOST_PATTERNS = 2_000      # patterns of gaps whose moments the driver works on; more stay in a table


def _matrix(batch) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])


def _replay(raw: np.ndarray, means: np.ndarray, updates: list) -> np.ndarray:
    """Start from means, then apply the regressions in the order they were learnt."""
    gap = np.isnan(raw)
    x = np.where(gap, means, raw)
    for target, others, weights, base in updates:
        rows = gap[:, target]
        if rows.any():
            x[rows, target] = x[rows][:, others] @ weights + base
    return x


def _sums(rows: DataFrame, make, size: int) -> np.ndarray:
    """Sum a vector of ``size`` figures over all batches, one partial per task."""
    def run(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += make(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype="int32")), pa.array(total)], names=["i", "v"])

    out = np.zeros(size)
    for r in rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def _pattern_moments(data: DataFrame, means: np.ndarray) -> DataFrame:
    """(gaps, n, sums, cross): per pattern of gaps the moments of the known values about the means. A task adds up what it sees of each."""
    p = len(means)

    def run(batches):
        held: dict[bytes, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            raw = _matrix(b)
            gap = np.isnan(raw)
            u = np.where(gap, 0.0, raw - means)
            packed = np.packbits(gap, axis=1)
            patterns, own = np.unique(packed, axis=0, return_inverse=True)
            order = np.argsort(own.ravel(), kind="stable")
            ends = np.searchsorted(own.ravel()[order], np.arange(len(patterns) + 1))
            for i, key in enumerate(patterns):
                z = u[order[ends[i]:ends[i + 1]]]
                add = np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
                old = held.get(key.tobytes())
                held[key.tobytes()] = add if old is None else old + add
            if len(held) > 4 * MOST_PATTERNS:
                yield pack(held)
                held = {}
        if held:
            yield pack(held)

    def pack(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))],
                                          names=["gaps", "moments"])

    each = data.mapInArrow(run, "gaps binary, moments array<double>")
    # Equal places of the arrays are added; a pattern is a row for each task at most.
    at = lambda i: F.sum(F.get("moments", F.lit(i)))     # noqa: E731
    return each.groupBy("gaps").agg(F.array(*[at(i) for i in range(1 + p + p * p)]).alias("moments"))


def _affine(gaps: np.ndarray, means: np.ndarray, updates: list) -> tuple[np.ndarray, np.ndarray]:
    """(T, c): rows with these gaps are ``T u + c`` after the updates, about the means, with ``u`` their known values."""
    t, c = np.diag((~gaps).astype(float)), np.zeros(len(gaps))
    for target, others, weights, base in updates:
        if gaps[target]:
            t[target] = weights @ t[others]
            c[target] = weights @ c[others] + means[others] @ weights + base - means[target]
    return t, c


def _filled(moments: np.ndarray, gaps: np.ndarray, means: np.ndarray, updates: list) -> np.ndarray:
    """The moments (n, sums, cross-products about the means) of a pattern's rows after the updates."""
    p = len(gaps)
    n, s, cross = moments[0], moments[1:1 + p], moments[1 + p:].reshape(p, p)
    t, c = _affine(gaps, means, updates)
    ts = t @ s
    return np.concatenate([[n], ts + n * c, (t @ cross @ t.T + np.outer(ts, c) + np.outer(c, ts) + n * np.outer(c, c)).ravel()])


class _Patterns:
    """Moments of all rows in which a column is known, after some updates."""

    def __init__(self, table: DataFrame, means: np.ndarray):
        self.means, self.p = means, len(means)
        self.table = materialize(table, "gap-patterns")
        few = self.table.limit(MOST_PATTERNS + 1).toArrow()
        self.few = list(self._rows(few)) if few.num_rows <= MOST_PATTERNS else None

    def _rows(self, batch):
        for gaps, moments in zip(batch.column("gaps").to_pylist(), batch.column("moments").to_pylist()):
            yield np.unpackbits(np.frombuffer(gaps, np.uint8))[:self.p].astype(bool), np.array(moments)

    def where_known(self, target: int, updates: list) -> np.ndarray:
        if self.few is not None:
            return sum((_filled(m, g, self.means, updates) for g, m in self.few if not g[target]), np.zeros(1 + self.p + self.p ** 2))
        rows, means = self._rows, self.means
        add = lambda b: sum((_filled(m, g, means, updates) for g, m in rows(b) if not g[target]), np.zeros(1 + len(means) + len(means) ** 2))
        return _sums(self.table, add, 1 + self.p + self.p ** 2)


def _largest(data: DataFrame, make) -> float:
    def run(batches):
        top = 0.0
        for b in batches:
            if b.num_rows:
                top = max(top, make(_matrix(b)))
        yield pa.RecordBatch.from_arrays([pa.array([top])], names=["v"])

    return data.mapInArrow(run, "v double").agg(F.max("v")).first()[0] or 0.0


def bayesian_ridge(n: float, sx: np.ndarray, sy: float, xx: np.ndarray, xy: np.ndarray, yy: float,
                   max_iter: int = 300, tol: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and intercept by evidence maximisation, from centred moments.

    ``sx``/``sy`` are means; ``xx``/``xy``/``yy`` centred cross-products. Gamma
    priors of 1e-6 on the noise and weight precisions.
    """
    prior = 1e-6
    values, vectors = np.linalg.eigh(xx)
    values = np.clip(values, 0.0, None)
    projected = vectors.T @ xy
    alpha, lam = 1.0 / (yy / n + np.finfo(float).eps), 1.0
    weights = np.zeros(len(xy))
    for step in range(max_iter):
        previous = weights
        weights = vectors @ (projected / (values + lam / alpha))
        residual = max(yy - 2 * weights @ xy + weights @ xx @ weights, 0.0)
        gamma = np.sum(alpha * values / (lam + alpha * values))
        lam = (gamma + 2 * prior) / (weights @ weights + 2 * prior)
        alpha = (n - gamma + 2 * prior) / (residual + 2 * prior)
        if step and np.sum(np.abs(previous - weights)) < tol:
            break
    weights = vectors @ (projected / (values + lam / alpha))
    return weights, float(sy - sx @ weights)


def impute_chained(df: DataFrame, columns: list[str] | None = None, max_iter: int = 10, tol: float = 1e-3) -> DataFrame:
    """Fill numeric gaps by regressing each column on the others, round by round.

    Columns go from fewest to most gaps and come back as doubles. Stops after
    ``max_iter`` rounds or when the largest change of a row is below ``tol``
    times the largest known value.
    """
    df = fold_nan(df)
    columns = numeric_columns(df) if columns is None else columns
    stats = column_stats(df, columns, ("mean", "min", "max"), columns)
    df = replace_columns(df, {c: quoted(c).cast("double") for c in columns})
    columns = [c for c in columns if stats.count[c] > 0]
    gaps = sorted((i for i, c in enumerate(columns) if stats.count[c] < stats.rows),
                  key=lambda i: (stats.rows - stats.count[columns[i]], i))
    if not gaps:
        return df
    means = np.array([stats.get(c, "mean") for c in columns])
    largest = max(abs(stats.get(c, b)) for c in columns for b in ("min", "max"))
    p = len(columns)
    data = df.select([quoted(c).alias(f"x{i}") for i, c in enumerate(columns)])
    updates: list = []
    if p > 1:
        patterns = _Patterns(_pattern_moments(data, means), means)
        some = F.lit(False)
        for i in gaps:
            some = some | F.col(f"x{i}").isNull()
        open_rows = materialize(data.where(some), "rows-with-gaps")
        for _ in range(max_iter):
            start = len(updates)
            for target in gaps:
                others = [i for i in range(p) if i != target]
                got = patterns.where_known(target, updates)
                order = others + [target]
                n, s, cross = got[0], got[1:1 + p][order], got[1 + p:].reshape(p, p)[np.ix_(order, order)]
                centred = cross - np.outer(s, s) / n
                mean = s / n + means[order]
                weights, base = bayesian_ridge(n, mean[:-1], mean[-1], centred[:-1, :-1], centred[:-1, -1], centred[-1, -1])
                updates.append((target, others, weights, base))
            before, after = updates[:start], updates[:]
            moved = _largest(open_rows, lambda raw: float(np.abs(_replay(raw, means, after) - _replay(raw, means, before)).sum(axis=1).max()))
            if moved < tol * largest:
                break

    def fill(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            names = b.schema.names
            at = [names.index(c) for c in columns]
            raw = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in at])
            x = _replay(raw, means, updates)
            arrays = [b.column(i) for i in range(b.num_columns)]
            for j, i in enumerate(at):
                arrays[i] = pa.array(x[:, j])
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(fill, df.schema)
