"""Matching files of two instruments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Left rows of a key that one task takes; a key with more is split.
CELL = 1 << 16
#: Keys that can be split. A key that is not among the largest has at most this fraction of all rows.
HOT = 10_000


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], prefix: str = ""
) -> DataFrame:
    """The first row of every key in ``order``, as an aggregation.

    Unlike a ranking window it reduces inside the map tasks, so a key with a
    large share of the rows costs one row per task.
    """
    best = F.expr(f"min_by(struct({', '.join(values)}), struct({', '.join(order)})) AS _best")
    out = df.groupBy(*keys).agg(best)
    return out.selectExpr(*keys, *[f"_best.{v} AS {prefix}{v}" for v in values])


def hot_keys(sizes_of: DataFrame, keys: Sequence[str], cell: int = CELL) -> DataFrame:
    """``keys, _salts``: the keys with more than ``cell`` rows, at most ``HOT`` of them, and into how many parts they go.

    Sizes come from counts reduced in the map tasks, so a hot key is one number per task here.
    """
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    sizes = sizes_of.where(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(f"_rows > {cell}")
    largest = sizes.orderBy(F.col("_rows").desc(), *keys).limit(HOT)
    return largest.selectExpr(*keys, f"int(ceil(_rows / {cell})) AS _salts")


def salted_left_join(
    left: DataFrame, unique_right: DataFrame, keys: Sequence[str], row_id: str, sizes_of: DataFrame | None = None, cell: int = CELL
) -> DataFrame:
    """Left join to a side that has one row per key, with hot keys split by their measured size.

    A key with more than ``cell`` left rows is dealt over as many tasks as it needs, and its one right row is repeated
    as often; all other right rows stay single. Left rows without a key match nothing: they are spread by ``row_id``
    instead of meeting in one task. Sizes are counted in ``sizes_of``, by default ``left``; a caller whose left side is
    costly names a cheaper frame with the same keys, since it is read a second time for the count.
    """
    hot = F.broadcast(hot_keys(left if sizes_of is None else sizes_of, keys, cell))  # at most HOT rows
    none = " OR ".join(f"{k} IS NULL" for k in keys)
    lhs = left.join(hot, [*keys], "left").selectExpr(
        *left.columns, f"int(if({none}, pmod(xxhash64({row_id}), {HOT}), pmod(xxhash64({row_id}), coalesce(_salts, 1)))) AS _salt"
    )
    rhs = unique_right.join(hot, [*keys], "left").selectExpr(
        *unique_right.columns, "explode(sequence(0, coalesce(_salts, 1) - 1)) AS _salt"
    )
    return lhs.join(rhs, [*keys, "_salt"], "left").drop("_salt")


def pair_first_match(
    left: DataFrame,
    right: DataFrame,
    bucket: str,
    order: Sequence[str],
    values: Sequence[str],
    row_id: str,
    prefix: str = "",
    by: Sequence[str] = (),
    sizes_of: DataFrame | None = None,
) -> DataFrame:
    """Every left row with the first right row of the same quarter-hour, else NULLs.

    ``by`` names further keys, such as the station. Rows without a bucket, or
    without one of these keys, match nothing. ``sizes_of`` as in :func:`salted_left_join`.
    """
    keys = [*by, bucket]
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    firsts = first_per_key(right.where(known), keys, order, values, prefix)
    return salted_left_join(left, firsts, keys, row_id, sizes_of)


def ordinal(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str = "n", cell: str | None = None
) -> DataFrame:
    """Position (from 1) of each row inside its group, without one task per group.

    ``cell`` is an expression that never falls along ``order`` (the hour of a time,
    the first letters of a name; by default the first column of the order). Rows
    are counted by cell, the counts of a group's earlier cells are added up, and
    rows are ranked inside their cell. So no task holds more than a cell, or a
    group's cell counts, nothing is written, and nothing runs before the result
    is asked for.
    """
    celled = df.withColumn("_cell", F.expr(cell or order[0]))
    keys = [*groups, "_cell"]
    earlier = Window.partitionBy(*groups).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = celled.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    starts = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    placed = celled.withColumn("_place", F.row_number().over(inside))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = placed.join(starts, same)
    return joined.select(*df.columns, (F.col("_before") + F.col("_place")).alias(name))


def pair_by_position(
    left: DataFrame,
    right: DataFrame,
    groups: Sequence[str],
    left_order: Sequence[str],
    right_order: Sequence[str],
    right_values: Sequence[str],
    prefix: str,
    left_cell: str | None = None,
    right_cell: str | None = None,
) -> DataFrame:
    """n-th left row with the n-th right row inside each group (for instance a day)."""
    lhs = ordinal(left, groups, left_order, cell=left_cell)
    rhs = ordinal(right, groups, right_order, cell=right_cell)
    rhs = rhs.select(*groups, "n", *[F.col(v).alias(f"{prefix}{v}") for v in right_values])
    return lhs.join(rhs, [*groups, "n"], "left")
