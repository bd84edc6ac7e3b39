"""Streams against batch, and restart from a checkpoint."""

import datetime as dt

import rawfiles as rf

from verdance.sources import raw
from verdance.streaming import jobs

T0 = dt.datetime(2016, 7, 18, 16, 0, 40)


def drop(folder, ts, text, prefix="QE_PRO_"):
    (folder / rf.name(ts, prefix)).write_text(text)


def test_ingest_takes_up_only_new_files(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    out, checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")
    drop(landing, T0, rf.qe_file(T0))
    drop(landing, T0 + dt.timedelta(minutes=1), rf.hr_file(T0), "HR2000PLUS_")
    drop(landing, T0 + dt.timedelta(minutes=2), "broken")
    jobs.ingest_folder(spark, str(landing), out, checkpoint).awaitTermination()
    first = spark.read.parquet(out)
    assert first.count() == 3 and first.where("parse_ok = true").count() == 2
    later = T0 + dt.timedelta(minutes=15)
    drop(landing, later, rf.qe_file(later))
    jobs.ingest_folder(spark, str(landing), out, checkpoint).awaitTermination()
    table = spark.read.parquet(out)
    assert table.count() == 4
    batch = raw.parse(raw.discover(spark, str(landing)))
    cols = ["file_name", "obs_ts", "inte_t1_us", "n_rows", "parse_error"]
    assert sorted(map(str, table.select(cols).collect())) == sorted(map(str, batch.select(cols).collect()))


def test_redelivery_under_another_path(spark, tmp_path):
    for night in ("n1", "n2"):
        (tmp_path / "landing" / night).mkdir(parents=True)
        drop(tmp_path / "landing" / night, T0, rf.qe_file(T0))
    drop(tmp_path / "landing" / "n2", T0 - dt.timedelta(days=40), "broken")
    args = (spark, str(tmp_path / "landing"), str(tmp_path / "t"), str(tmp_path / "c"), "2 days")
    jobs.ingest_folder(*args).awaitTermination()
    (tmp_path / "landing" / "n3").mkdir()
    drop(tmp_path / "landing" / "n3", T0, rf.qe_file(T0))
    jobs.ingest_folder(*args).awaitTermination()
    names = sorted(r.file_name for r in spark.read.parquet(str(tmp_path / "t")).collect())
    assert names == sorted([rf.name(T0, "QE_PRO_"), rf.name(T0 - dt.timedelta(days=40), "QE_PRO_")])


def test_a_good_file_follows_a_truncated_one(spark, tmp_path):
    """Equal names with other text are no repeats: two stations, a cut upload, and an old back-fill all arrive."""
    import os

    landing = tmp_path / "landing"
    for night in ("n1", "n2", "n3"):
        (landing / night).mkdir(parents=True)
    whole = rf.qe_file(T0)
    drop(landing / "n1", T0, whole[: len(whole) // 2])
    args = (spark, str(landing), str(tmp_path / "t"), str(tmp_path / "c"), "2 days")
    jobs.ingest_folder(*args).awaitTermination()
    drop(landing / "n2", T0, whole)
    drop(landing / "n3", T0, rf.qe_file(T0, t=(2_000_000, 1_000_000)))
    old = landing / "n3" / rf.name(T0, "QE_PRO_")
    os.utime(old, (old.stat().st_mtime - 5 * 86400,) * 2)
    (landing / "n3" / "misnamed.CSV").write_text("?")
    jobs.ingest_folder(*args).awaitTermination()
    table = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(str(r.parse_error) for r in table.collect()) == ["None", "None", "bad_length", "unknown_file"]
    best = raw.best_delivery(table.drop("parse_ok", "obs_date"), ("file_name",))
    assert {r.file_name: r.parse_error for r in best.collect()} == {rf.name(T0, "QE_PRO_"): None, "misnamed.CSV": "unknown_file"}


def test_a_table_as_a_folder_of_parts(spark, sf_dir, tmp_path):
    """A file and a folder of part files give the same stream."""
    from verdance.streaming import tables

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    counts = [jobs.drain(tables.events(spark, d).select("event_id"), "t").count() for d in (sf_dir, str(tmp_path))]
    assert counts == [events.count()] * 2


def as_stream(spark, folder, batches, schema):
    """One Parquet file per batch, taken in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
        .parquet(str(folder))
    )


def test_redelivered_names_are_dropped_across_batches(spark, tmp_path):
    batches = [[("a", T0), ("b", T0), ("a", T0)], [("a", T0), ("c", T0)]]
    stream = as_stream(spark, tmp_path / "in", batches, "file_name string, ts timestamp_ntz")
    files = stream.selectExpr("file_name", f"{jobs.instant('ts')} AS obs_ts")
    out = jobs.drain(jobs.drop_redelivered(files, "obs_ts"), "t")
    assert sorted(r.file_name for r in out.collect()) == ["a", "b", "c"]


def test_rollup_emits_closed_windows_and_drops_late_rows(spark, tmp_path):
    hours = dt.timedelta(hours=1)
    batches = [
        [("QE", T0, 1.0), ("QE", T0 + 40 * hours, 5.0)],
        [("QE", T0 + 41 * hours, 7.0)],
        [("QE", T0 - 30 * hours, 100.0), ("QE", T0 + 90 * hours, 9.0)],
    ]
    stream = as_stream(spark, tmp_path / "in", batches, "instrument string, ts timestamp_ntz, v double")
    rolled = jobs.rollup(
        stream.selectExpr("*", f"{jobs.instant('ts')} AS at"), "at", "1 day", ["instrument"],
        {"n": "count(1)", "mean_v": "avg(v)"}, "6 hours",
    )
    out = {r.window_start.date(): (r.n, r.mean_v) for r in jobs.drain(rolled, "t").collect()}
    # the row thirty hours behind arrives after its day was closed; the last day is still open
    assert out == {T0.date(): (1, 1.0), (T0 + 40 * hours).date(): (2, 6.0)}


def test_pairing_picks_first_by_name_and_keeps_the_unmatched(spark, tmp_path):
    mins = dt.timedelta(minutes=1)
    left = [[(1, T0), (2, T0 + 20 * mins), (9, T0 + 2000 * mins)]]
    right = [[("b", T0 + 2 * mins, 1.0), ("a", T0 + 4 * mins, 2.0), ("z", T0 + 2000 * mins, 3.0)]]
    a = as_stream(spark, tmp_path / "a", left, "id int, ts timestamp_ntz")
    b = as_stream(spark, tmp_path / "b", right, "name string, ts timestamp_ntz, v double")
    paired = jobs.pair_streams(
        a.selectExpr("id", f"{jobs.instant('ts')} AS at"),
        b.selectExpr("name", "v", f"{jobs.instant('ts')} AS at"),
        "at", ["name"], ["name", "v"], "id", "b_",
    )
    out = {r.id: (r.b_name, r.b_v) for r in jobs.drain(paired, "t").collect()}
    assert out == {1: ("a", 2.0), 2: (None, None)}


def test_instant_reads_naive_times_as_utc(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        df = spark.createDataFrame([(T0,)], "ts timestamp_ntz")
        row = df.selectExpr(
            f"unix_micros({jobs.instant('ts')}) AS us", f"string({jobs.naive(jobs.instant('ts'))}) AS back"
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert row.us == int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    assert row.back == "2016-07-18 16:00:40"


# ---- published tables


def daily(path):
    from verdance.streaming import published

    values = {"n": published.COUNT, "total": published.total("v"), "first": published.first_by(["name"], ["v"])}
    return published.Windows(str(path), "at", "1 day", ("instrument",), values)


def test_published_days_hold_late_rows_and_open_windows(spark, tmp_path):
    from verdance.streaming import published

    hours = dt.timedelta(hours=1)
    batches = [
        [("QE", "b", T0, 1.0), ("QE", "a", T0 + 40 * hours, 5.0), ("HR", "x", None, 7.0)],
        [("QE", "c", T0 + 41 * hours, 7.0)],
        [("QE", "a", T0 - 7 * hours, 100.0), (None, "z", T0 + 90 * hours, None)],
    ]
    schema = "instrument string, name string, ts timestamp_ntz, v double"
    stream = as_stream(spark, tmp_path / "in", batches, schema).selectExpr("*", f"{jobs.instant('ts')} AS at")
    table = daily(tmp_path / "table")
    published.publish(stream, table, str(tmp_path / "c")).awaitTermination()
    rows = spark.createDataFrame([], stream.schema)

    def seen():
        out = table.read(spark, rows).collect()
        return {(r.window_start.date(), r.instrument): (r.n, r.total, r.first["v_v"]) for r in out}

    want = {
        (T0.date(), "QE"): (2, 101.0, 100.0),
        ((T0 + 40 * hours).date(), "QE"): (2, 12.0, 5.0),
        ((T0 + 90 * hours).date(), None): (1, None, None),
    }
    assert seen() == want

    # a batch that is run again changes nothing, and touches its own days only
    again = spark.createDataFrame(batches[2], schema).selectExpr("*", f"{jobs.instant('ts')} AS at")
    day = tmp_path / "table" / "published" / f"day={(T0 + 40 * hours).date()}"
    before = sorted(p.name for p in day.iterdir())
    table.take(again, 2)
    assert seen() == want
    assert sorted(p.name for p in day.iterdir()) == before
    table.take(again, 3)
    assert seen()[T0.date(), "QE"] == (3, 201.0, 100.0)


def test_published_pairs_take_up_a_late_partner(spark, tmp_path):
    from verdance.streaming import published

    mins = dt.timedelta(minutes=1)
    schema = "id int, kind string, station string, name string, ts timestamp_ntz"
    batches = [
        [(1, "a", "s", "p", T0), (2, "a", "s", "q", T0 + 20 * mins), (3, "a", "t", "r", T0), (4, "a", None, "r", T0)],
        [(11, "b", "s", "n", T0 + mins), (12, "b", "t", "n", T0 + 1500 * mins), (13, "b", None, "n", T0)],
        [(14, "b", "s", "m", T0 - 30 / 60 * mins), (15, "b", "s", "z", T0 + 21 * mins), (5, "a", "s", "u", None)],
    ]
    table = published.Pairs(str(tmp_path / "t"), "at", "kind = 'a'", "id", ("id",), ("name",), ("id", "name"), "b_", ("station",))
    frames = [spark.createDataFrame(b, schema).selectExpr("*", f"{jobs.instant('ts')} AS at") for b in batches]

    def seen():
        return {r.id: r.b_id for r in table.read(spark, frames[0].limit(0)).collect()}

    table.take(frames[0], 0)
    assert seen() == {1: None, 2: None, 3: None, 4: None}
    table.take(frames[1], 1)
    assert seen() == {1: 11, 2: None, 3: None, 4: None}
    for _ in range(2):
        table.take(frames[2], 2)
        assert seen() == {1: 14, 2: 15, 3: None, 4: None}


def test_a_ledger_of_deliveries(spark, tmp_path):
    """Truncated then good, a repeat, two stations in one second, a misnamed file, and a batch that runs twice."""
    from verdance.streaming import published

    whole, other = rf.qe_file(T0), rf.qe_file(T0, t=(2_000_000, 1_000_000))
    name = rf.name(T0, "QE_PRO_")
    landing = tmp_path / "landing"
    table = published.Deliveries(str(tmp_path / "t"))
    args = (str(landing), True, r"/(s\d)/[^/]+/[^/]+$")

    def put(station, night, text, as_name=name):
        (landing / station / night).mkdir(parents=True, exist_ok=True)
        (landing / station / night / as_name).write_text(text)

    def take():
        files = jobs.ingest(raw.discover(spark, *args), keep=["station"]).drop("obs_date", "parse_ok")
        published.publish(files, table, str(tmp_path / "c")).awaitTermination()
        return {(r.station, r.file_name): (r.parse_error, r.inte_t1_us) for r in table.read(spark, empty).collect()}

    empty = raw.parse(spark.createDataFrame([], "station string, file_name string, value string"), keep=("station",))
    put("s1", "n1", whole[: len(whole) // 2])
    put("s2", "n1", other)
    assert take() == {("s1", name): ("bad_length", 1_500_000), ("s2", name): (None, 2_000_000)}
    put("s1", "n2", whole)
    put("s2", "n2", whole[:300])
    put("s1", "n2", "?", "misnamed.csv")
    want = {("s1", name): (None, 1_500_000), ("s2", name): (None, 2_000_000), ("s1", "misnamed.csv"): ("unknown_file", None)}
    assert take() == want
    put("s1", "n3", other)  # a good one that comes later doesn't replace a good one
    assert take() == want
    again = spark.createDataFrame([("s1", name, other)], "station string, file_name string, value string")
    table.take(raw.parse(again, keep=("station",)), 2)
    assert {(r.station, r.file_name): (r.parse_error, r.inte_t1_us) for r in table.read(spark, empty).collect()} == want
