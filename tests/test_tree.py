"""The histogram tree against a plain search of every split."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from tablescope.operators.tree import baseline_tree, fit_tree

BINS = 8
DDL = "a double, t string, b int, y string, v double"


def _rows(n, seed):
    rng = np.random.default_rng(seed)
    a, b, t = rng.normal(size=n), rng.integers(0, 4, n), rng.choice(["red", "green", "blue", "é"], n)
    y = np.where((a > 0.3) ^ (t == "red"), "yes", np.where(b == 2, "no", "maybe"))
    rows = [(float(a[i]), str(t[i]), int(b[i]), str(y[i]), float(3 * b[i] + (a[i] > 0))) for i in range(n)]
    return rows + [(None, "red", 1, "yes", 1.0), (1.0, None, 1, "yes", 1.0), (float("nan"), "red", 1, "no", 1.0)] + rows[:5]


def _brute(rows, target, classify, depth, least):
    rows = [r for r in rows if all(x is not None and x == x for x in r)]
    lows, highs = ([f(r[i] for r in rows) for i in (0, 2)] for f in (min, max))

    def bins(r):
        number = lambda x, lo, hi: max(0, min(BINS - 1, int(np.floor((x - lo) / (hi - lo) * BINS)))) if hi > lo else 0
        return number(r[0], lows[0], highs[0]), int(hashlib.md5(r[1].encode()).hexdigest()[:4], 16) % BINS, number(r[2], lows[1], highs[1])

    data, splits, leaves = [(bins(r), r[target]) for r in rows], {}, {}

    def score(part):
        if classify:
            return sum(k * k for k in Counter(y for _, y in part).values()) / len(part)
        return sum(y for _, y in part) ** 2 / len(part)

    def grow(node, part, left):
        options = []
        for f in range(3) if left else ():
            for b in range(BINS):
                one = [p for p in part if (p[0][f] == b if f == 1 else p[0][f] <= b)]
                two = [p for p in part if not (p[0][f] == b if f == 1 else p[0][f] <= b)]
                if min(len(one), len(two)) >= least and any(p[0][f] == b for p in part):
                    options.append((-round(score(one) + score(two) - score(part), 6), f, b, one, two))
        best = min(options, key=lambda o: o[:3], default=None)
        if best and best[0] < 0:
            splits[node] = best[1:3]
            grow(2 * node, best[3], left - 1)
            grow(2 * node + 1, best[4], left - 1)
        else:
            found = min((-k, y) for y, k in Counter(y for _, y in part).items())[1] if classify else sum(y for _, y in part) / len(part)
            leaves[node] = (len(part), found)

    grow(1, data, depth)
    return splits, leaves


@pytest.mark.parametrize("classify", [True, False])
def test_tree_equals_every_split(make, classify):
    rows = _rows(300, 5)
    target = "y" if classify else "v"
    tree = fit_tree(make(rows, DDL), target, ["a", "t", "b"], classify, depth=3, bins=BINS, min_rows=4)
    splits, leaves = _brute([(*r[:3], r[3 if classify else 4]) for r in rows], 3, classify, 3, 4)
    assert tree.splits == splits and len(splits) > 3
    got = {r["node"]: (r["rows"], r["prediction"]) for r in tree.leaves.collect()}
    assert got.keys() == leaves.keys() and all(got[n][0] == leaves[n][0] for n in got)
    assert all(got[n][1] == (leaves[n][1] if classify else pytest.approx(leaves[n][1])) for n in got)
    assert [r["node"] for r in tree.rules()] == sorted(splits)


def test_tree_predicts_complete_rows_and_keeps_columns(make):
    df = make(_rows(200, 6), DDL).withColumnRenamed("v", "b0")
    tree = fit_tree(df, "y", ["a", "t", "b"], depth=4, min_rows=1)
    out = tree.predict(df, "guess")
    assert out.columns == [*df.columns, "guess"] and out.count() == 205
    assert out.where("guess = y").count() > 0.8 * 205


def test_tree_on_constant_and_empty_tables(make):
    flat = fit_tree(make([(1.0, "x", 1, "yes", 0.0)] * 20, DDL), "y", ["a", "t", "b"])
    assert flat.splits == {} and [tuple(r) for r in flat.leaves.collect()] == [(1, 20, "yes")]
    empty = fit_tree(make([], DDL), "y", ["a", "t", "b"])
    assert empty.splits == {} and empty.leaves.count() == 0
    assert baseline_tree(make([], DDL), "y", "b").count() == 0
