"""Structured Streaming jobs over the same column expressions as the batch plans.

Watermarks need a TIMESTAMP, while instrument times are naive. The jobs read
a naive time as UTC, so day and quarter-hour windows do not depend on the
session time zone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdance.profiles import InstrumentProfile
from verdance.session import scratch_path
from verdance.sources import raw


#: Parts of every quarter-hour in the state of a stream join, whose sizes can't be known before.
SALTS = 16


def instant(ts: str) -> str:
    """Naive time to the instant with the same reading in UTC."""
    return (
        f"make_timestamp(year({ts}), month({ts}), day({ts}), hour({ts}), minute({ts}),"
        f" extract(SECOND FROM {ts}), 'UTC')"
    )


def naive(ts: str) -> str:
    """Reading of an instant in UTC."""
    return f"convert_timezone(current_timezone(), 'UTC', cast({ts} AS TIMESTAMP_NTZ))"


# --- running ------------------------------------------------------------------

def start(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    partition_by: Sequence[str] = (),
    state_partitions: int | None = None,
) -> StreamingQuery:
    """Write everything now available as Parquet, exactly once, then stop.

    Run it again with the same checkpoint to take up only what is new. A checkpoint
    keeps its number of state partitions for life: that of the session, or
    ``state_partitions`` where a caller knows that its state stays small.
    """
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if state_partitions is None:
        return writer.start()
    conf, key = stream.sparkSession.conf, "spark.sql.shuffle.partitions"
    configured = conf.get(key)
    conf.set(key, str(state_partitions))
    try:
        return writer.start()  # the query keeps its own copy of the settings
    finally:
        conf.set(key, configured)


def drain(
    stream: DataFrame, label: str, partition_by: Sequence[str] = (), state_partitions: int | None = None
) -> DataFrame:
    """Run to the end of the input into the shared scratch folder and read it back."""
    spark = stream.sparkSession
    base = scratch_path(spark, label)
    query = start(stream, f"{base}/table", f"{base}/checkpoint", partition_by, state_partitions)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


# --- file drop ------------------------------------------------------------------

def ingest(
    files: DataFrame, profiles: Mapping[str, InstrumentProfile] = raw.PROFILES, keep: Sequence[str] = ()
) -> DataFrame:
    """Parsed files of a stream of ``file_name, value``; ``keep`` names further columns, such as the station.

    Good and bad files go to one sink, split by the ``parse_ok`` folder. The
    file sink commits a batch as a whole, so a lost executor or driver can
    neither repeat nor drop a file, which two separate writes could.
    """
    return raw.parse(files, profiles, tuple(keep)).selectExpr(
        "*", "to_date(obs_ts) AS obs_date", "parse_error IS NULL AS parse_ok"
    )


INGEST_FOLDERS = ("parse_ok", "instrument", "obs_date")


def ingest_folder(
    spark: SparkSession, landing: str, path: str, checkpoint: str, redelivery: str | None = None
) -> StreamingQuery:
    """Take up the files that arrived in ``landing`` since the last run.

    The file source never reads a path twice. With ``redelivery`` (for instance
    ``'2 days'``) a file that arrives again under another path within that time
    is dropped as well. Only equal text under an equal name counts as a repeat: a
    truncated upload does not keep out the whole file that follows, and two
    stations may have a run in the same second. Time is that of the take-up, so
    a back-fill with old modification times is never late.
    """
    files = raw.discover(spark, landing, streaming=True)
    if redelivery is not None:
        files = files.selectExpr("*", "current_timestamp() AS taken_up", "sha2(value, 256) AS content")
        files = drop_redelivered(files, "taken_up", ["file_name", "content"], redelivery).drop("taken_up", "content")
    return start(ingest(files), path, checkpoint, INGEST_FOLDERS)


def drop_redelivered(
    files: DataFrame, ts: str, keys: Sequence[str] = ("file_name",), delay: str = "1 day"
) -> DataFrame:
    """Drop files whose ``keys`` were seen within ``delay``; state is kept that long only.

    ``ts`` should be the time of the take-up: by any other time a file can be
    too late, and is then dropped by the watermark.
    """
    return files.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


# --- windows and pairing -----------------------------------------------------------

def rollup(
    stream: DataFrame,
    ts: str,
    every: str,
    keys: Sequence[str],
    values: Mapping[str, str],
    delay: str = "1 day",
) -> DataFrame:
    """Tumbling-window aggregates, one row per closed window and key.

    Append mode: rows later than ``delay`` are dropped and windows that the watermark
    has not passed are not yet in the result. ``published.Windows`` keeps a table
    that has both.
    """
    aggs = [F.expr(f"{e} AS {n}") for n, e in values.items()]
    out = stream.withWatermark(ts, delay).groupBy(F.window(ts, every), *keys).agg(*aggs)
    return out.selectExpr(
        f"{naive('window.start')} AS window_start", *keys, *values
    )


def pair_streams(
    left: DataFrame,
    right: DataFrame,
    ts: str,
    order: Sequence[str],
    values: Sequence[str],
    row_id: str,
    prefix: str,
    delay: str = "1 hour",
    salts: int = SALTS,
) -> DataFrame:
    """Left rows with the first right row of their quarter-hour, NULLs without one.

    The right stream is reduced to one row per quarter-hour before the join, so
    a crowded quarter-hour adds no combinations to the state; its left rows are
    spread over ``salts`` partitions.
    """
    bucket = F.window(ts, "15 minutes")
    best = F.expr(f"min_by(struct({', '.join(values)}), struct({', '.join(order)})) AS best")
    firsts = (
        right.withWatermark(ts, delay)
        .groupBy(bucket.alias("slot"))
        .agg(best)
        .selectExpr(
            "slot",
            *[f"best.{v} AS {prefix}{v}" for v in values],
            f"explode(sequence(0, {salts - 1})) AS _salt",
        )
    )
    # the window takes over as the one event-time column of the join
    held = [c for c in left.columns if c != ts]
    lhs = left.withWatermark(ts, delay).select(
        *held,
        F.expr(naive(ts)).alias("_at"),
        bucket.alias("slot"),
        F.expr(f"int(pmod(xxhash64({row_id}), {salts}))").alias("_salt"),
    )
    out = lhs.join(firsts, ["slot", "_salt"], "left_outer")
    return out.selectExpr(
        *held,
        f"_at AS {ts}",
        f"{naive('slot.start')} AS bucket_ts",
        *[f"{prefix}{v}" for v in values],
    )
