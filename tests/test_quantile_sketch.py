"""Exact quantiles do not depend on the sketch that brackets them."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescope.operators import quantiles as Q


def _rows(data: pd.DataFrame) -> list[tuple]:
    return [tuple(None if v != v else float(v) for v in r) for r in data.to_numpy().tolist()]


@pytest.mark.parametrize("limit", [Q.MAX_BRACKET_ROWS, 50])
def test_first_quantile_sketch_is_the_cheap_one(make, monkeypatch, limit):
    """Exact whatever the sketch says: NaN, infinities, heavy values and gaps included."""
    rng = np.random.default_rng(6)
    data = pd.DataFrame({"a": rng.lognormal(0, 3, 4000), "b": rng.integers(0, 3, 4000).astype(float), "c": np.where(rng.random(4000) < 0.3, np.nan, rng.normal(size=4000))})
    df = make(_rows(data), "a double, b double, c double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    if limit == Q.MAX_BRACKET_ROWS:
        monkeypatch.setattr(F, "percentile_approx", None)
    got = Q.exact_quantiles(df, {c: probs for c in data}, limit)
    for c in data:
        for p in probs:
            assert math.isclose(got[c][p], data[c].quantile(p), rel_tol=1e-12)
    odd = make([(float("nan"), None), (float("inf"), None), (1.0, None), (-float("inf"), None), (2.0, None)], "x double, y double")
    assert Q.exact_quantiles(odd, {"x": [0.25, 0.5, 0.75], "y": [0.5]}) == {"x": {0.25: 1.0, 0.5: 2.0, 0.75: float("inf")}, "y": {0.5: None}}
    only = make([(float("nan"),), (float("nan"),)], "x double")
    assert math.isnan(Q.exact_quantiles(only, {"x": [0.5]})["x"][0.5])
