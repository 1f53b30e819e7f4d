"""CSV files with line breaks inside quotes, cut into many byte ranges."""

import csv
import io
import random

import pytest

from tablescope.sources import csv_blocks as B
from tablescope.sources.csv_source import read_csv


@pytest.fixture
def small_ranges(spark):
    """Ranges of some 200 bytes, as a large file has of 128 MB."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def content(seed, n=120):
    rnd = random.Random(seed)
    part = lambda: rnd.choice(["plain", 'a "quoted" word', "two\nlines", "comma, here", "", 'ends in ""', '"', "\n", "é日", 'x" pipe', "many\n\n\nbreaks\n", "word " * 80])     # noqa: E731
    return [[str(i), part(), part()] for i in range(n)]


def written(rows, sep=","):
    out = io.StringIO()
    csv.writer(out, delimiter=sep, lineterminator="\n").writerows([["id", "first", "second"], *rows])
    return out.getvalue()


@pytest.mark.parametrize("seed,sep", [(1, ","), (2, ";"), (3, "|")])
def test_many_ranges_equal_one_reader(spark, tmp_path, small_ranges, seed, sep):
    rows = content(seed)
    text = written(rows, sep)
    (tmp_path / "t.csv").write_text(text)
    found = B.records(spark, str(tmp_path / "t.csv"), sep, "UTF-8")
    assert spark.read.text(str(tmp_path / "t.csv")).rdd.getNumPartitions() > 20
    got = [r["text"] for r in found.orderBy("block", "no").collect()]
    want = list(csv.reader(io.StringIO(text), delimiter=sep))
    assert [next(csv.reader(io.StringIO(t), delimiter=sep)) for t in got] == want


def test_read_csv_of_a_cut_file(spark, tmp_path, small_ranges):
    rows = [[i, f"line one\nline {i}" if i % 3 else "flat", i * 1.5] for i in range(300)]
    (tmp_path / "a.csv").write_text(written(rows))
    (tmp_path / "b.csv").write_text(written([[1000, 'one\n"two"', 2.5]]))
    out, warnings = read_csv(spark, str(tmp_path))
    got = sorted(map(tuple, out.collect()))
    assert got == sorted([(i, a, b) for i, a, b in rows] + [(1000, 'one\n"two"', 2.5)]) and len(warnings) == 1
    assert dict(out.dtypes) == {"id": "bigint", "first": "string", "second": "double"}


def test_a_record_over_many_ranges_and_an_open_end(spark, tmp_path, small_ranges):
    """A field of 40 ranges; a record that the file never ends; latin-1; an overlong record."""
    long = "\n".join(f"line {i} of a long note" for i in range(400))
    (tmp_path / "t.csv").write_bytes(f'id,note\n1,"{long}"\n2,caf\xe9\n3,"x",4\n5,"never\nclosed'.encode("latin-1"))
    out, warnings = read_csv(spark, str(tmp_path / "t.csv"))
    got = {r["id"]: r["note"] for r in out.collect()}
    assert got[1] == long and got[2] == "café" and 3 not in got and len(warnings) == 3


@pytest.mark.parametrize("line,outside,inside", [
    ("a,b", False, True), ('a,"b', True, False), ('"a""b",c', False, False), ('"""', True, False), ('""', False, True), ("", False, True), ('x"y', False, False),
    ('a","b', True, True), ('a"",b', False, True), ('"a"x,"b"', False, False)])
def test_states_of_lines(spark, line, outside, inside):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(line,)], "line string")
    row = df.select(B._stays_open(F.col("line"), ","), B._stays_open(F.concat(F.lit('"'), "line"), ",")).first()
    assert row[0] == outside
    assert row[1] == inside
