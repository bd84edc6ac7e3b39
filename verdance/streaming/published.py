"""Published tables that late rows still change.

A watermark closes windows for good: what comes later is dropped, and what is open is not yet in the result. Here a
micro-batch is reduced to mergeable values instead, which are kept at rest by day and batch, and only the days that the
batch touched are merged again and written over. So the published table holds open windows and late rows at all times,
nothing is kept in memory between batches, and a batch costs what it touched and not the table.

Every write of a batch replaces the folders of just that batch, or of just the days it touched. A batch that is run
again after a lost driver therefore leaves the same tables. Readers see a day as it was or as it is while nothing else
writes to it: one query publishes one table.

Rows without a time belong to no day and are left out, as they are from windows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdance.operators import level1
from verdance.operators.pairing import salted_left_join
from verdance.profiles import InstrumentProfile
from verdance.session import scratch_path
from verdance.streaming.jobs import naive

DAY, BATCH = "day", "batch"


@dataclass(frozen=True)
class Mergeable:
    """A value that batches hold in parts: the aggregate of a batch's rows, and the aggregate of such parts.

    ``merge`` names the part as ``part``. ``Mergeable("sum(v)", "sum(part)")``, ``Mergeable("min(struct(name, v))",
    "min(part)")``.
    """

    reduce: str
    merge: str


COUNT = Mergeable("count(1)", "sum(part)")


def total(expr: str) -> Mergeable:
    return Mergeable(f"sum({expr})", "sum(part)")


def counted(expr: str) -> Mergeable:
    return Mergeable(f"count({expr})", "sum(part)")


def first_by(order: Sequence[str], values: Sequence[str]) -> Mergeable:
    """The least row in ``order``, with ``values``."""
    fields = [*(f"{c} AS o{i}" for i, c in enumerate(order)), *(f"{c} AS v_{c}" for c in values)]
    return Mergeable(f"min(struct({', '.join(fields)}))", "min(part)")


# --- tables at rest ---------------------------------------------------------------


def replace_batch(rows: DataFrame, path: str, batch: int) -> None:
    """Write a batch's rows (with ``day``) below ``path``, in place of an earlier try of the same batch."""
    _overwrite(rows.withColumn(BATCH, F.lit(batch).cast("long")), path, [DAY, BATCH])


def replace_days(rows: DataFrame, path: str, days: Sequence[str] = (DAY,)) -> None:
    """Write whole days; days that ``rows`` has no row of stay as they are."""
    _overwrite(rows, path, list(days))


def _overwrite(rows: DataFrame, path: str, folders: list[str]) -> None:
    # a day's rows go to a task, or to several if the day is large
    dealt = rows.hint("rebalance", *folders)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)


def of_days(spark: SparkSession, path: str, schema: str, days: DataFrame) -> DataFrame:
    """The rows of a table at rest on ``days``; Spark reads the folders of these days only."""
    table = spark.read.schema(schema).parquet(path)
    return table.join(days, DAY, "left_semi")


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in (DAY, BATCH)), *more])


# --- windows ------------------------------------------------------------------------


def reduced(rows: DataFrame, ts: str, every: str, keys: Sequence[str], values: Mapping[str, Mergeable]) -> DataFrame:
    """Parts of every window of the rows: ``window_start``, keys, values and the day of the window."""
    known = rows.where(f"{ts} IS NOT NULL").withColumn("_window", F.window(ts, every))
    parts = known.groupBy("_window", *keys).agg(*[F.expr(f"{v.reduce} AS {n}") for n, v in values.items()])
    at = parts.selectExpr(f"{naive('_window.start')} AS window_start", *keys, *values)
    return at.withColumn(DAY, F.to_date("window_start"))


def merged(parts: DataFrame, keys: Sequence[str], values: Mapping[str, Mergeable]) -> DataFrame:
    """Parts of several batches to one row per window and key."""
    aggs = [F.expr(f"{v.merge.replace('part', n)} AS {n}") for n, v in values.items()]
    return parts.groupBy(DAY, "window_start", *keys).agg(*aggs)


@dataclass(frozen=True)
class Windows:
    """A published table of tumbling windows below ``path``; ``every`` divides a day or is one."""

    path: str
    ts: str
    every: str
    keys: tuple[str, ...]
    values: Mapping[str, Mergeable]

    def take(self, rows: DataFrame, batch: int) -> None:
        """Take up a batch: its parts replace an earlier try of it, then its days are merged again."""
        spark = rows.sparkSession
        parts = reduced(rows, self.ts, self.every, self.keys, self.values)
        replace_batch(parts, f"{self.path}/parts", batch)
        schema = _schema(parts, f"{DAY} date", f"{BATCH} long")
        written = spark.read.schema(schema).parquet(f"{self.path}/parts").where(F.col(BATCH) == batch)
        touched = written.select(DAY).distinct()
        again = of_days(spark, f"{self.path}/parts", schema, touched)
        replace_days(merged(again, self.keys, self.values), f"{self.path}/published")

    def read(self, spark: SparkSession, rows: DataFrame) -> DataFrame:
        """The published windows; ``rows`` gives the types."""
        parts = merged(reduced(rows, self.ts, self.every, self.keys, self.values), self.keys, self.values)
        return spark.read.schema(_schema(parts, f"{DAY} date")).parquet(f"{self.path}/published")


# --- pairing --------------------------------------------------------------------------


@dataclass(frozen=True)
class Pairs:
    """A published table of left rows with the first right row of their quarter-hour and ``by`` keys.

    Rows of both sides come in one stream, told apart by ``is_left``. Left rows are kept by day and batch, right rows as
    the first of each quarter-hour and batch. A row of either side that comes late changes its day only.
    """

    path: str
    ts: str
    is_left: str
    row_id: str
    held: tuple[str, ...]
    order: tuple[str, ...]
    values: tuple[str, ...]
    prefix: str
    by: tuple[str, ...] = ()
    every: str = "15 minutes"

    def _left(self, rows: DataFrame) -> DataFrame:
        known = rows.where(f"({self.is_left}) AND {self.ts} IS NOT NULL").withColumn("_window", F.window(self.ts, self.every))
        out = known.selectExpr(*self.by, *self.held, f"{naive('_window.start')} AS bucket_ts")
        return out.withColumn(DAY, F.to_date("bucket_ts"))

    def _right(self, rows: DataFrame) -> DataFrame:
        known = [f"{k} IS NOT NULL" for k in (self.ts, *self.by)]
        rows = rows.where(" AND ".join([f"NOT ({self.is_left})", *known]))
        return reduced(rows, self.ts, self.every, self.by, {"first": first_by(self.order, self.values)})

    def take(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        left, right = self._left(rows), self._right(rows)
        sides = {}
        for name, side in (("left", left), ("right", right)):
            replace_batch(side, f"{self.path}/{name}", batch)
            sides[name] = _schema(side, f"{DAY} date", f"{BATCH} long")
        tables = {n: spark.read.schema(s).parquet(f"{self.path}/{n}") for n, s in sides.items()}
        days = [t.where(F.col(BATCH) == batch).select(DAY) for t in tables.values()]
        touched = days[0].unionByName(days[1]).distinct()
        lefts = of_days(spark, f"{self.path}/left", sides["left"], touched).drop(BATCH)
        rights = of_days(spark, f"{self.path}/right", sides["right"], touched)
        replace_days(self._paired(lefts, rights), f"{self.path}/published")

    def _paired(self, lefts: DataFrame, rights: DataFrame) -> DataFrame:
        firsts = merged(rights, self.by, {"first": first_by(self.order, self.values)})
        firsts = firsts.selectExpr(*self.by, "window_start AS bucket_ts", *[f"first.v_{v} AS {self.prefix}{v}" for v in self.values])
        return salted_left_join(lefts, firsts, [*self.by, "bucket_ts"], self.row_id)

    def read(self, spark: SparkSession, rows: DataFrame) -> DataFrame:
        paired = self._paired(self._left(rows), self._right(rows))
        return spark.read.schema(_schema(paired, f"{DAY} date")).parquet(f"{self.path}/published")


# --- deliveries -----------------------------------------------------------------------


@dataclass(frozen=True)
class Deliveries:
    """A published table of parsed files, one row per ``keys``, whatever arrived for them and in which order.

    Every delivery is entered in a ledger by day and batch. Published is, of a file's deliveries, a good one if there
    is any, and of these the one that came first; so a whole file takes the place of the truncated one before it, a
    repeat changes nothing, and two stations with a run in the same second stay two files. There is no window after
    which a delivery comes too late and no state that has to hold what was seen.

    Files without a time in their name are kept under ``NO_DAY``.
    """

    path: str
    keys: tuple[str, ...] = ("station", "file_name")

    #: The day of files that have none.
    NO_DAY = "0001-01-01"

    def _dated(self, files: DataFrame) -> DataFrame:
        return files.withColumn(DAY, F.coalesce(F.to_date("obs_ts"), F.lit(self.NO_DAY).cast("date")))

    def take(self, files: DataFrame, batch: int) -> None:
        """``files``: parsed rows with ``parse_error``, good and bad."""
        spark = files.sparkSession
        dated = self._dated(files)
        replace_batch(dated, f"{self.path}/ledger", batch)
        schema = _schema(dated, f"{DAY} date", f"{BATCH} long")
        ledger = spark.read.schema(schema).parquet(f"{self.path}/ledger")
        touched = ledger.where(F.col(BATCH) == batch).select(DAY).distinct()
        replace_days(self.best(of_days(spark, f"{self.path}/ledger", schema, touched)), f"{self.path}/published")

    def best(self, ledger: DataFrame) -> DataFrame:
        """One row per file; which delivery is chosen by error, batch and content, before any spectrum moves twice."""
        rest = [c for c in ledger.columns if c not in (*self.keys, DAY, BATCH)]
        rank = F.struct(F.col("parse_error").isNotNull().alias("bad"), F.col(BATCH), F.xxhash64(*rest).alias("content"))
        best = ledger.groupBy(DAY, *self.keys).agg(F.min_by(F.struct(*rest), rank).alias("_best"))
        return best.select(DAY, *self.keys, "_best.*")

    def read(self, spark: SparkSession, files: DataFrame) -> DataFrame:
        types = _schema(self.best(self._dated(files).withColumn(BATCH, F.lit(0).cast("long"))), f"{DAY} date")
        return spark.read.schema(types).parquet(f"{self.path}/published")


# --- fits -----------------------------------------------------------------------------


@dataclass(frozen=True)
class DailyFits:
    """A published table of one fit per day, ``by`` keys and pair over all files of the day.

    Batches of observations (one row per file, with calibration) leave the sums of their fits, a few numbers per pair,
    and the sums of a touched day are merged and solved again. No batch fits a file again that an earlier one had.
    """

    path: str
    profile: InstrumentProfile
    by: tuple[str, ...] = ()

    def _keys(self) -> list[str]:
        return [DAY, *self.by, "pair_no"]

    def _sums(self, obs: DataFrame) -> DataFrame:
        dated = obs.where("obs_ts IS NOT NULL").withColumn(DAY, F.to_date("obs_ts"))
        sums = level1.fluorescence_sums(dated, self.profile, [DAY, *self.by, "file_id"])
        return level1.merged_fluorescence_sums(sums, self.profile, self._keys())

    def _fits(self, sums: DataFrame) -> DataFrame:
        whole = level1.merged_fluorescence_sums(sums, self.profile, self._keys())
        return level1.fluorescence_of(whole, self.profile, self._keys())

    def take(self, obs: DataFrame, batch: int) -> None:
        spark = obs.sparkSession
        sums = self._sums(obs)
        replace_batch(sums, f"{self.path}/sums", batch)
        schema = _schema(sums, f"{DAY} date", f"{BATCH} long")
        touched = spark.read.schema(schema).parquet(f"{self.path}/sums").where(F.col(BATCH) == batch).select(DAY).distinct()
        replace_days(self._fits(of_days(spark, f"{self.path}/sums", schema, touched)), f"{self.path}/published")

    def read(self, spark: SparkSession, obs: DataFrame) -> DataFrame:
        schema = _schema(self._fits(self._sums(obs)), f"{DAY} date")
        return spark.read.schema(schema).parquet(f"{self.path}/published")


# --- running ----------------------------------------------------------------------------


def publish(stream: DataFrame, table: Windows | Pairs | Deliveries | DailyFits, checkpoint: str) -> StreamingQuery:
    """Take up everything now available, batch by batch, then stop; run it again for what is new."""

    def each(rows: DataFrame, batch: int) -> None:
        held = rows.persist()  # read twice or more: the source is asked once
        try:
            table.take(held, batch)
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def published(stream: DataFrame, make: Callable[[str], Windows | Pairs | Deliveries | DailyFits], label: str) -> DataFrame:
    """Run to the end of the input below the shared scratch folder and read the published table."""
    spark = stream.sparkSession
    base = scratch_path(spark, label)
    table = make(f"{base}/table")
    publish(stream, table, f"{base}/checkpoint").awaitTermination()
    rows = spark.createDataFrame([], stream.schema)
    return table.read(spark, rows)
