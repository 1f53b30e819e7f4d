"""Stored analyses: whole, by version, made anew when the files change."""

import pandas as pd

from tablescope.sources import store


def test_analysis_is_stored_whole_and_noticed_when_stale(spark, make, tmp_path):
    data, root = str(tmp_path / "data"), str(tmp_path / "root")
    rows = [(i, float(i % 7), "ab"[i % 2]) for i in range(60)]
    make(rows, "k int, x double, s string").write.parquet(data)
    assert store.load_analysis(spark, root) is None
    first, fresh = store.analyze_once(spark, "t", data, root)
    assert fresh and first.profile.metrics.first()["rows"] == 60
    again, fresh = store.analyze_once(spark, "t", data, root)
    assert not fresh
    for name, table in store._parts(first).items():
        assert sorted(map(str, table.collect())) == sorted(map(str, store._parts(again)[name].collect())), name
    make(rows, "k int, x double, s string").write.mode("append").parquet(data)
    changed, fresh = store.analyze_once(spark, "t", data, root)
    assert fresh and changed.profile.metrics.first()["rows"] == 120
    assert changed.insights.where("category = 'duplicates'").count() >= 1 and changed.score.count() == 1
    store.analyze_once(spark, "u", data, root)
    assert store.load_analysis(spark, root).score.count() == 2 and store.load_analysis(spark, root, ["t"]).score.count() == 1
    assert isinstance(store.current(spark, root).toPandas(), pd.DataFrame)
