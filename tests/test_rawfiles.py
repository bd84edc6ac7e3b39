"""Raw files under their own names: written, found, read back and parsed."""

import datetime as dt
import os

import pyarrow.parquet as pq
import pytest
import rawfiles as rf
from compare import differences, duck
from pyspark.sql import functions as F

from verdance.plans.oracle import ORACLE
from verdance.plans.queries import QUERIES
from verdance.sources import raw
from verdance.sources import rawfiles as R

T0 = dt.datetime(2016, 7, 18, 16, 0, 40)


def tree(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names)


def test_every_row_comes_back_under_its_name(spark, tmp_path):
    rows = []
    for station in ("s1", "s2", None):
        for k in range(6):
            ts = T0 + dt.timedelta(minutes=15 * k)
            rows.append((station, rf.name(ts, "QE_PRO_"), rf.qe_file(ts)))
            rows.append((station, rf.name(ts, "HR2000PLUS_"), rf.hr_file(ts)))
    rows.append(("s1/deep", "odd ü.csv", "é\r\n"))
    rows.append(("s2", "empty.csv", ""))
    df = spark.createDataFrame(rows, "folder string, file_name string, value string").repartition(5)
    path = str(tmp_path / "out")
    R.write_files(df, path)
    assert tree(path) == sorted("/".join(filter(None, r[:2])) for r in rows)
    found = R.read_files(spark, f"file://{path}", 400_000)
    assert sorted(map(str, found.select("folder", "file_name", "value").collect())) == sorted(map(str, df.collect()))
    assert found.where("arrived IS NULL").count() == 0
    # files go to tasks by bytes: neither one task a file nor one for all
    tasks = found.groupBy(F.spark_partition_id()).count().collect()
    assert 2 <= len(tasks) < len(rows) and max(r["count"] for r in tasks) < len(rows)
    parsed = raw.parse(raw.discover(spark, path, station=r"/(s\d)/[^/]+$"), keep=("station",))
    good = raw.good(parsed).select("station", "file_name")
    assert sorted(map(str, good.collect())) == sorted(map(str, df.where("length(value) > 100").select(F.col("folder").alias("station"), "file_name").collect()))
    # written again, the same files
    R.write_files(df, path)
    assert tree(path) == sorted("/".join(filter(None, r[:2])) for r in rows)


@pytest.mark.parametrize(
    "bad, error",
    [
        (("s1", "a.csv", "other"), "double_name"),
        (("s1", "../up.csv", "x"), "bad_name"),
        (("..", "up.csv", "x"), "bad_name"),
        (("s1", ".hidden.csv", "x"), "bad_name"),
        (("s1", None, "x"), "bad_name"),
        (("s1", "b.csv", None), "no_text"),
    ],
)
def test_a_failed_task_leaves_no_file(spark, tmp_path, bad, error):
    rows = [("s1", "a.csv", "text"), bad]
    df = spark.createDataFrame(rows, "folder string, file_name string, value string").coalesce(1)
    R.register(spark)
    with pytest.raises(Exception, match=error):
        df.write.format(R.FORMAT).mode("append").save(str(tmp_path / "out"))
    assert tree(tmp_path) == []


def test_nothing_to_write_and_nothing_to_read(spark, tmp_path):
    R.write_files(spark.createDataFrame([], "file_name string, value string"), str(tmp_path / "out"))
    (tmp_path / "out").mkdir(exist_ok=True)
    (tmp_path / "out" / "notes.txt").write_text("no spectrum")
    (tmp_path / "out" / "_hidden.csv").write_text("x")
    assert R.read_files(spark, str(tmp_path / "out")).collect() == []
    with pytest.raises(Exception, match="mode append"):
        spark.range(1).selectExpr("'a.csv' AS file_name", "'' AS value").write.format(R.FORMAT).mode("overwrite").save(str(tmp_path / "o"))


def test_files_of_one_path_are_set_apart(spark, tmp_path):
    rows = [("s1", "a.csv", t) for t in ("one", "two", "two")] + [("s2", "a.csv", "one"), (None, "a.csv", "x"), ("", "a.csv", "y")]
    df = spark.createDataFrame(rows, "folder string, file_name string, value string").repartition(4)
    path = str(tmp_path / "out")
    for _ in range(2):  # again after a failure: the same
        R.write_files(R.apart(df), path)
        assert tree(path) == sorted(f"{f}a.csv" for f in ("", "again-1/", "again-1/s1/", "again-2/s1/", "s1/", "s2/"))
    found = R.read_files(spark, path).select(F.substring_index("folder", "/", -1).alias("f"), "value").collect()
    assert sorted((r.f or "", r.value) for r in found) == sorted([("", "x"), ("again-1", "y"), *[r[::2] for r in rows[:4]]])
    # without folders
    R.write_files(R.apart(df.where("folder = 's1'").drop("folder")), str(tmp_path / "flat"))
    assert tree(tmp_path / "flat") == ["a.csv", "again-1/a.csv", "again-2/a.csv"]


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """Eight files of which two of each station began in one second; one of the events comes twice."""
    path = tmp_path_factory.mktemp("crowded")
    vectors = spark.range(0, 80, 1, 2).selectExpr(
        "id AS vec_id", "transform(sequence(1, 64), i -> float(pmod(hash(id, i), 1000) / 2000)) AS embedding", "1 AS label"
    )
    events = spark.range(8).selectExpr(
        "id AS event_id",
        "timestamp_ntz'2024-01-05 10:00:00' + make_dt_interval(0, 0, 0, id % 4 + id / 10) AS ts",
        "id AS user_id",
        "'view' AS event_type",
        "id * 1.5D AS value",
        "'{}' AS props",
    )
    events = events.unionByName(events.where("event_id = 2"))
    for name, df in (("embeddings", vectors), ("events", events)):
        pq.write_table(df.toArrow(), path / f"{name}.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["raw_files_by_name", "raw_discovered", "raw_discovered_stream"])
def test_runs_of_one_second_are_all_found(spark, crowded, name):
    got = QUERIES[name](spark, crowded).toPandas()
    assert len(got) == 9 and got["file_name"].nunique() == 4
    assert differences(got, duck(crowded).execute(ORACLE[name]).df()) == []
