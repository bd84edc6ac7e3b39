"""Helpers of the training-data operators: tables, lineage cuts, distributed ranks, components."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdance.session import scratch_path

#: A word is a run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package; a cluster installs it or takes ``--py-files``."""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if here not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([here, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_records: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables that :func:`cut` writes meanwhile."""
    _records.append([])
    try:
        yield _records[-1]
    finally:
        _records.pop()


def drop_tables(spark: SparkSession, paths: Sequence[str]) -> None:
    """Delete written tables that nothing reads any more, wherever the shared folder lies."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts the lineage with files that outlive executors, and gives later joins true sizes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    for paths in _records:
        paths.append(path)
    df.write.parquet(path)
    if _records:
        # Spark drops the files of finished shuffles when the driver collects its garbage; a chain of stages asks for it
        spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows: int,
    along: DataFrame | None = None,
    cell: int = 4096,
) -> DataFrame:
    """Adds ``rank``: 0, 1, ... within ``keys``, and the columns that ``along`` has for the keys.

    Rows of a key are dealt over hash cells of about ``cell`` rows, however hot the key; a cell's ranks start
    where the counts of the key's earlier cells end, so no task sees more than a cell or a key's cell counts.
    Rows equal in ``order`` are interchangeable; ``rows`` is the number of rows of ``df``.
    """
    dealt = df.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(max(1, -(-rows // cell)))))
    by_key = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(*keys, "_cell")
        .agg(F.count("*").alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(by_key), F.lit(0)))
        .drop("_n")
    )
    more = []
    if along is not None:
        more = [c for c in along.columns if c not in keys]
        starts = starts.join(along, [starts[k].eqNullSafe(along[k]) for k in keys]).select(
            *[starts[k] for k in keys], "_cell", "_start", *more
        )
    inside = Window.partitionBy(*keys, "_cell").orderBy(*order)
    numbered = dealt.withColumn("_row", F.row_number().over(inside) - 1)
    out = numbered.join(starts, [numbered[k].eqNullSafe(starts[k]) for k in (*keys, "_cell")])
    return out.select(
        *[numbered[c] for c in df.columns], *[starts[c] for c in more], (F.col("_start") + F.col("_row")).alias("rank")
    )


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root): the smallest node reachable over undirected ``edges`` (a, b); nodes without an edge are absent.

    Alternating large and small stars. Each round writes its edges, at most as many as there were.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links, before = cut(links, label), None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        links = cut(small, label)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
