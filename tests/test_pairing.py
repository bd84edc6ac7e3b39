import pandas as pd
from pyspark.sql import functions as F

from verdance.operators.pairing import first_per_key, hot_keys, ordinal, pair_by_position, pair_first_match, salted_left_join


def test_first_match_by_name_with_hot_bucket(spark):
    """A third of the rows share one quarter-hour; nothing is dropped or doubled."""
    left = spark.range(0, 30_000, 1, 8).selectExpr("id", "if(id % 3 = 0, 0, id % 400) AS bucket")
    right = spark.range(0, 30_000, 1, 8).selectExpr(
        "if(id % 3 = 0, 0, id % 350) AS bucket", "concat('n', lpad(id, 6, '0')) AS name", "id * 2 AS v"
    )
    out = pair_first_match(left, right, "bucket", ["name"], ["name", "v"], "id", "b_").toPandas()
    first = right.toPandas().sort_values("name").drop_duplicates("bucket").set_index("bucket")
    want = left.toPandas()
    want["b_name"] = want.bucket.map(first.name)
    assert len(out) == len(want)
    merged = out.merge(want, on="id", suffixes=("", "_w"))
    same = (merged.b_name == merged.b_name_w) | (merged.b_name.isna() & merged.b_name_w.isna())
    assert same.all()
    assert merged.b_name.isna().sum() > 0


def test_no_partner_and_no_bucket(spark):
    left = spark.createDataFrame([(1, 5), (2, None), (3, 6)], "id int, bucket int")
    right = spark.createDataFrame([(5, "b", 1.0), (5, "a", 2.0), (None, "c", 3.0)], "bucket int, name string, v double")
    out = {r.id: r.v for r in pair_first_match(left, right, "bucket", ["name"], ["v"], "id").collect()}
    assert out == {1: 2.0, 2: None, 3: None}


def test_first_per_key_keeps_null_values(spark):
    df = spark.createDataFrame([(1, 2, "x"), (1, 1, None)], "k int, o int, v string")
    assert [tuple(r) for r in first_per_key(df, ["k"], ["o"], ["v"]).collect()] == [(1, None)]


def test_ordinal_equals_rank_with_hot_group(spark):
    df = spark.range(0, 20_000, 1, 8).selectExpr(
        "id", "if(id % 3 = 0, 'hot', concat('g', id % 50)) AS g", "pmod(hash(id), 1000003) AS o"
    )
    got = ordinal(df, ["g"], ["o", "id"]).toPandas().sort_values("id", ignore_index=True)
    want = df.toPandas().sort_values(["g", "o", "id"])
    want["n"] = want.groupby("g").cumcount() + 1
    want = want.sort_values("id", ignore_index=True)
    pd.testing.assert_series_equal(got.n, want.n, check_dtype=False)


def test_ordinal_without_group_and_with_null_group(spark):
    df = spark.createDataFrame([(None, "b"), (None, "a"), ("x", "c")], "g string, o string")
    assert {r.o: r.n for r in ordinal(df, [], ["o"]).collect()} == {"a": 1, "b": 2, "c": 3}
    assert {r.o: r.n for r in ordinal(df, ["g"], ["o"]).collect()} == {"a": 1, "b": 2, "c": 1}


def test_positions(spark):
    left = spark.createDataFrame([("d1", "q2"), ("d1", "q1"), ("d2", "q3"), ("d1", "q4")], "day string, name string")
    right = spark.createDataFrame([("d1", "h9"), ("d1", "h5"), ("d2", "h1"), ("d2", "h2")], "day string, hr string")
    out = pair_by_position(left, right, ["day"], ["name"], ["hr"], ["hr"], "b_").collect()
    assert {r.name: r.b_hr for r in out} == {"q1": "h5", "q2": "h9", "q4": None, "q3": "h1"}


def test_only_hot_keys_are_split(spark):
    """A key with a third of the rows goes to several tasks, rows without a key to many; other right rows stay single."""
    left = spark.range(0, 60_000, 1, 8).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 0 WHEN id % 3 = 1 THEN NULL ELSE id % 4000 + 1 END AS k"
    )
    right = spark.range(0, 5000).selectExpr("id AS k", "id * 2 AS v")
    hot = {r.k: r._salts for r in hot_keys(left, ["k"], 1000).collect()}
    assert hot == {0: 20}
    out = salted_left_join(left, right, ["k"], "id", cell=1000)
    got = out.toPandas()
    assert len(got) == 60_000 and got.id.is_unique
    known = got[got.k.notna()]
    assert (known.v == known.k * 2).all() and got[got.k.isna()].v.isna().all()
    # the rows of a task, dealt as the join deals them
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        dealt = salted_left_join(left, right, ["k"], "id", cell=100).groupBy(F.spark_partition_id()).count()
        rows = sorted(r["count"] for r in dealt.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == 40 and rows[-1] < 2 * rows[20]
