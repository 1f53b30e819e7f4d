import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.functions import query_text as Q
from tablescope.functions.vectors import cosine
from tablescope.operators import profile as P
from tablescope.plans import search as S
from tablescope.session import scratch_path
from tablescope.sources import catalog as G
from tablescope.sources.csv_source import UnreadableFileError, read_csv
from tablescope.sources.files import discover_files, first_lines
from tablescope.sources.store import load_profile, profile_once, save_profile, write

AS_OF = "2024-06-30 00:00:00"
CATALOG = "id string, title string, description string, source string, format string, size_bytes bigint, tags array<string>, last_updated string, author string, license string"


def _text(spark, fn, *values):
    df = spark.createDataFrame([(v,) for v in values], "q string")
    return [r[0] for r in df.select(fn(F.col("q"))).collect()]


def test_query_text(spark):
    assert _text(spark, Q.text_normalize, "  Héllo,  World-Wide! ", "***") == ["h llo world-wide", ""]
    assert _text(spark, Q.text_sanitize, "sales dataset csv", "the best data", "data csv", "a") == ["sales", "the best", "data csv", "a"]
    assert _text(spark, Q.text_keywords, "Sales data", "data csv", "the of", "x") == [["sales"], ["csv"], ["the", "of"], []]
    assert _text(spark, Q.query_intent, "detect and classify", "nothing") == ["classification", None]


def test_expansion_order_and_limit(spark):
    fn = lambda q: Q.query_expand(q, Q.text_keywords(q))
    assert _text(spark, fn, "stock text prices", "nothing here") == ["stock text prices financial market nlp corpus", "nothing here"]
    assert _text(spark, fn, "image text sales") == ["image text sales revenue commerce images pictures"]


def test_cosine(make):
    df = make([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0]


def _entry(i, title, description="d" * 30, source="github", tags=("a", "b"), updated="2024-06-20T00:00:00Z", author="me", size=5, fmt="csv"):
    return (i, title, description, source, fmt, size, list(tags), updated, author, "mit")


def test_dedup_keeps_the_richest_then_the_earliest(make):
    cat = make([_entry("1", "Sales data", description=""), _entry("2", "SALES dataset (CSV)", source="kaggle"), _entry("3", "sales"), _entry("4", "data csv"), _entry("5", "***"),
                _entry("6", "Other"), _entry("7", "other!")], CATALOG)
    assert sorted(r["id"] for r in S.dedup(cat).collect()) == ["2", "4", "5", "6"]


@pytest.mark.parametrize("updated, points", [("2024-06-20T00:00:00Z", 25), ("2024-04-20T00:00:00Z", 20), ("2023-09-01T00:00:00Z", 10), ("2020-01-01T00:00:00Z", 5),
                                             ("2024-06-20T00:00:00", 5), ("junk", 5), ("", 0)])
def test_metadata_score(make, updated, points):
    cat = make([_entry("1", "t", updated=updated)], CATALOG)
    assert cat.select(S.metadata_score(AS_OF)).first()[0] == 75 + points


def test_scores_and_floors(spark, make):
    cat = make([_entry("1", "Weather report", "", tags=(), author="Unknown", size=0, updated="")], CATALOG)
    floor = lambda q: S.score_catalog(cat, q, as_of=AS_OF).first()["relevance"]
    assert (floor("zebra"), floor("report weather"), floor("weather report")) == (12.0, 20.0, 35.0)
    row = S.score_catalog(cat.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0))), "zebra", query_vector=[1.0, 0.0], as_of=AS_OF).first()
    assert row["semantic"] == 100.0 and row["relevance"] == 51.5 and row["quality"] == "medium"


def test_intent_score(spark):
    df = spark.createDataFrame([("fraud and spam",), ("detection",), ("none",)], "t string")
    assert [r[0] for r in df.select(Q.intent_score(F.col("t"), F.lit("detection"))).collect()] == [50.0, 80.0, 0.0]


def test_filters_let_the_unknown_pass(make):
    mb = 1024 ** 2
    cat = make([_entry("small", "a", size=mb), _entry("medium", "b", size=50 * mb), _entry("large", "c", size=2000 * mb), _entry("unknown", "d", size=0, updated=""),
                _entry("old", "e", size=mb, updated="2020-01-01T00:00:00Z", fmt="json")], CATALOG)
    ids = lambda **f: sorted(r["id"] for r in S.filter_catalog(cat, as_of=AS_OF, **f).collect())
    assert ids(size="small") == ["old", "small", "unknown"] and ids(size="medium") == ["medium", "unknown"] and ids(size="large") == ["large", "unknown"]
    assert "old" not in ids(freshness="month") and "unknown" in ids(freshness="day") and ids(formats=["json"]) == ["old"]
    assert len(ids(size="all", freshness="all")) == 5


def test_search_pages(make):
    cat = make([_entry(f"{i:02d}", f"Topic {i}") for i in range(25)], CATALOG)
    page = S.search(cat, "topic", page=3, limit=10, as_of=AS_OF)
    assert (page.total, page.pages, [r["id"] for r in page.rows.collect()]) == (25, 3, [f"{i:02d}" for i in range(20, 25)])


def test_topk_batch_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_DONORS", 7)
    monkeypatch.setattr(S, "BLOCK_QUERIES", 4)
    rng = np.random.default_rng(8)
    v = rng.normal(size=(40, 6))
    docs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, embedding array<double>")
    got = S.similarity_topk_batch(docs.withColumnRenamed("id", "qid"), docs, 3, "qid", "id").orderBy("qid", "rank").collect()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = np.argsort(-(unit @ unit.T), axis=1)[:, :3].ravel().tolist()
    assert [r["id"] for r in got] == want


def test_embedder_is_unit_length(spark):
    df = spark.createDataFrame([("sun and sea",), ("moon over sea",), ("sea salt",)], "t string")
    lengths = [np.linalg.norm(r["embedding"]) for r in S.embed(df, "t", dims=32).collect()]
    assert all(abs(x - 1) < 1e-9 or x == 0 for x in lengths)
    text = spark.range(1).select(S.embedding_text("weather data csv", "daily")).first()[0]
    assert text == "weather. daily. weather climate meteorological"


def _file(tmp_path, name, data: bytes):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    return str(path)


def test_plain_csv(spark, tmp_path):
    df, warnings = read_csv(spark, _file(tmp_path, "a.csv", b'id,name,v,ok,when\n1,"Smith, J",1.5,true,2024-01-01\n2,NA,,false,2024-01-02\n'))
    assert warnings == [] and [t for _, t in df.dtypes] == ["bigint", "string", "double", "boolean", "string"]
    assert [tuple(r)[:4] for r in df.orderBy("id").collect()] == [(1, "Smith, J", 1.5, True), (2, None, None, False)]


def test_ragged_rows_separator_and_encoding(spark, tmp_path):
    data = "id;näme;v\n1;Zoë;2\n2;x;3;extra;more\n3;short\n".encode("latin-1")
    df, warnings = read_csv(spark, _file(tmp_path, "b.csv", data))
    assert len(warnings) == 2 and df.columns == ["id", "näme", "v"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "Zoë", 2), (3, "short", None)]


def test_repeated_names_cap_and_empty_file(spark, tmp_path):
    df, warnings = read_csv(spark, _file(tmp_path, "c.csv", b"a,a,\n1,2,3\n4,5,6\n"), max_rows=1, order_by=["a"])
    assert df.columns == ["a", "a.1", "column_2"] and df.count() == 1 and warnings
    for empty in (b"", b"a,b\n"):
        with pytest.raises(UnreadableFileError):
            read_csv(spark, _file(tmp_path, f"e{len(empty)}.csv", empty))


def test_line_breaks_inside_quotes(spark, tmp_path):
    df, warnings = read_csv(spark, _file(tmp_path, "q.csv", b'id,note,n\n1,"hello\nworld, ""x""",3\n2,plain,4\n'))
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 'hello\nworld, "x"', 3), (2, "plain", 4)] and len(warnings) == 1


def test_each_file_has_its_own_layout(spark, tmp_path):
    _file(tmp_path, "mix d/a.csv", b"id,price,qty\n1,2.5,3\n")
    _file(tmp_path, "mix d/b.csv", b"id,qty,price\n2,30,25.5\n")
    _file(tmp_path, "mix d/c.csv", "id;name\n3;Zoë\n".encode("latin-1"))
    path = _file(tmp_path, "mix d/d[1].csv", "id,name\n4,Zoë\n".encode()).rsplit("/", 1)[0]
    df, warnings = read_csv(spark, path)
    assert [tuple(r) for r in df.select("id", "price", "qty", "name").orderBy("id").collect()] == [
        (1, 2.5, 3, None), (2, 25.5, 30, None), (3, None, None, "Zoë"), (4, None, None, "Zoë")]
    assert len(warnings) == 1 and warnings[0].startswith("1 of 4")


def test_every_overlong_record_is_left_out_and_counted(spark, tmp_path):
    df, warnings = read_csv(spark, _file(tmp_path, "o.csv", b'a,b,c\n1,2,3\n4,5,6,,LOST\n7,8,9,\n10,11\n,12,"13"\n,14\n'))
    assert sorted(tuple(-1 if v is None else v for v in r) for r in df.collect()) == [(-1, 12, 13), (-1, 14, -1), (1, 2, 3), (10, 11, -1)]
    assert warnings == ["Records with more fields than the header were left out: 2."]


def test_tab_and_pipe(spark, tmp_path):
    for name, sep in (("t.csv", "\t"), ("p.csv", "|")):
        df, _ = read_csv(spark, _file(tmp_path, name, sep.join("abc").encode() + b"\n" + sep.join("123").encode() + b"\n"))
        assert [tuple(r) for r in df.collect()] == [(1, 2, 3)]


def test_discovery(spark, tmp_path):
    _file(tmp_path, "root/one/small.csv", b"a\n1\n")
    _file(tmp_path, "root/one/deep/large.csv", b"a\n" + b"1\n" * 50)
    _file(tmp_path, "root/one/page.csv", b"  <!DOCTYPE html>" + b"x" * 500)
    _file(tmp_path, "root/two/huge.csv", b"1\n" * 5000)
    _file(tmp_path, "root/two/fine.csv", b"a\n2\n")
    _file(tmp_path, "root/three/empty.csv", b"")
    _file(tmp_path, "root/four/only.csv", b"<html>")
    got = {r["dataset"]: r["path"].split("/")[-1] for r in discover_files(spark, str(tmp_path / "root"), max_bytes=5000).collect()}
    assert got == {"one": "large.csv", "two": "fine.csv"}


def test_discovery_takes_no_job_per_folder(spark, tmp_path):
    def jobs(folders, label):
        for i in range(folders):
            _file(tmp_path, f"{label}/set {i}/page.csv", b"\n \n\t<HTML>" + b"\nx" * 500)
            _file(tmp_path, f"{label}/set {i}/a.csv", b"a\n" + b"1\n" * (i + 1))
            _file(tmp_path, f"{label}/set {i}/b.csv", b"a\n" + b"1\n" * (i + 1))
        spark.sparkContext.setJobGroup(label, label)
        try:
            found = {r["dataset"]: (r["path"].split("/")[-1], r["length"]) for r in discover_files(spark, str(tmp_path / label)).collect()}
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert found == {f"set {i}": ("a.csv", 2 * i + 4) for i in range(folders)}
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(label))

    assert jobs(60, "many+") <= jobs(12, "few") + 1


def test_discovery_reads_only_the_start_of_a_file(spark, tmp_path):
    _file(tmp_path, "big/one/a.csv", b"a,b\n" + b"1,2\n" * 3_000_000)
    first = first_lines(spark, str(tmp_path / "big"))
    assert [tuple(r)[1:] for r in first.collect()] == [(12_000_004, "a,b")]


def test_catalogue_records(make):
    raw = make([('{"ref": "me/set", "title": "T", "totalBytes": 2048}',), ('{"ref": "x", "totalBytes": 999999999999}',)], "record string")
    assert G.normalize_kaggle(raw).count() == 2       # no limit on sizes unless one is given
    row = G.normalize_kaggle(raw, max_bytes=200 << 20).collect()
    assert len(row) == 1 and (row[0]["author"], row[0]["size"], row[0]["license"], row[0]["tags"]) == ("me", "2.0 KB", "Unknown", [])
    hf = G.normalize_huggingface(make([('{"id": "me/my_nice-set", "cardData": {"description": "card"}, "downloads": 12345}',)], "record string")).first()
    assert (hf["title"], hf["description"], hf["size"], hf["license"]) == ("My Nice Set", "card", "12,345 downloads", "Unknown")
    gh = G.normalize_github(make([('{"full_name": "me/r-x", "name": "r-x", "size": 10}',)], "record string")).first()
    assert (gh["title"], gh["size"], gh["author"]) == ("R X", "10.0 KB", "Unknown")


def test_store_replaces_one_partition(spark, make):
    root = scratch_path(spark, "store-test")
    for name, n in (("a", 10), ("b", 20), ("a", 30)):
        save_profile(P.profile(make([(i, float(i)) for i in range(n)], "k int, v double"), name), root)
    rows = {r["dataset_id"]: r["rows"] for r in load_profile(spark, root).metrics.collect()}
    assert rows == {"a": 30, "b": 20}
    one = load_profile(spark, root, "a")
    assert one.columns.count() == 2
    assert "PartitionFilters: [isnotnull(dataset_id" in one.columns._jdf.queryExecution().toString()
    again = profile_once(make([(1,)], "other int"), "a", root)
    assert again.metrics.first()["rows"] == 30


def test_write_formats(spark, make):
    df = make([(1, "a,b"), (2, 'q"x')], "k int, s string")
    for fmt in ("csv", "parquet"):
        path = write(df, scratch_path(spark, "write-test"), fmt)
        back = read_csv(spark, path)[0] if fmt == "csv" else spark.read.parquet(path)
        assert sorted((r["k"], r["s"]) for r in back.collect()) == [(1, "a,b"), (2, 'q"x')]


def test_large_files_are_read_in_splits(spark, tmp_path):
    """The first line with text is found behind blank lines of several splits, and no partition is a whole file."""
    from tablescope.sources.files import discover_files, first_lines

    for name, text in (("a/page.csv", "\n \t\n" * 40000 + "<HTML>\n" + "x,y\n" * 40000), ("a/data.csv", "  k,v\n" + "1,2\n" * 20000), ("b/blank.csv", "\n\n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = {r["path"].rsplit("/", 1)[1]: r["line"] for r in first_lines(spark, str(tmp_path)).collect()}
        best = {r["dataset"]: r["path"].rsplit("/", 1)[1] for r in discover_files(spark, str(tmp_path)).collect()}
        parts = spark.read.option("recursiveFileLookup", "true").text(str(tmp_path)).rdd.getNumPartitions()
        plan = first_lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found == {"page.csv": "<HTML>", "data.csv": "k,v", "blank.csv": ""} and best == {"a": "data.csv", "b": "blank.csv"}
    assert parts > 10 and "FileScan text" in plan
