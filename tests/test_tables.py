"""The adapters for the test tables."""

from verdance.sources import tables as T


def test_repeated_rows_do_not_grow_a_file(spark, tmp_path):
    """One vector repeated until it holds a third of all rows leaves the files as they were."""
    clean = spark.range(0, 400, 1, 4).selectExpr(
        "id AS vec_id", "transform(sequence(1, 64), i -> float(pmod(hash(id, i), 1000) / 2000)) AS embedding", "1 AS label"
    )
    hot = clean.where("vec_id = 17").selectExpr("explode(sequence(1, 200)) AS k", "*").drop("k")
    for name, df in (("a", clean), ("b", clean.unionByName(hot))):
        (tmp_path / name).mkdir()
        df.write.parquet(str(tmp_path / name / "embeddings.parquet"))
    got = {n: T.observations(spark, str(tmp_path / n)).orderBy("file_id").toPandas() for n in ("a", "b")}
    assert len(got["a"]) == 40
    assert got["a"].map(str).equals(got["b"].map(str))


def test_instruments_split_the_files(spark, sf_dir):
    every = T.observations(spark, sf_dir).count()
    parts = [T.observations(spark, sf_dir, i) for i in ("QE", "HR")]
    assert [{r.instrument for r in p.collect()} for p in parts] == [{"QE"}, {"HR"}]
    assert sum(p.count() for p in parts) == every
