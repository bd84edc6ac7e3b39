"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Document rates r minimise the entropy distance from "each document once", sum r log r - r, such that every source gives
its target number of words and no rate exceeds ``most``. The solution is an exponential tilt, r = min(most, exp(t * z))
with z the document's length over its source's typical length; the tilts t maximise the convex dual. Newton steps,
kept inside a shrinking bracket, run over the histogram (source, size) -> documents, since equal sizes have equal rates.

Rates become whole copies by one pass of systematic rounding: along a source's documents in order of size the running
sum of rates is rounded, so each document gets its rate rounded down or up and a source misses its target by less
than its largest document; of ``OFFSETS`` starts of the running sum a source takes the one with the least miss. The
running sums are dealt over size zones, size classes and hash cells, so no source and no size meets in one task. All sums behind the rounding are integers: reruns agree.

A null text has size 0, a null source is a source of its own, sources without words have target 0, documents without
words keep rate 1. Repeated rows count each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdance.llm.common import WORD, cut, ranked

#: Relative distance from the target at which a source's tilt stands.
CLOSE = 1e-9
#: Newton steps; the bracket is halved at least every other step, so the distance is met long before.
STEPS = 80
#: Rates are whole multiples of 1 / ONE.
SHIFT = 20
ONE = 1 << SHIFT
#: Offsets that are tried for the rounding of a source.
OFFSETS = 64
#: Size zones per doubling of the size.
ZONES = 16


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and the number of words."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), words.alias("size"))


def targets(sized: DataFrame, weights: Sequence[int], most: float) -> DataFrame:
    """source, source_size, square (sum of squared sizes), target: one row a source.

    The weights repeat along the sources by code point, null last. Shares above ``most`` times a source's size go to
    the others by weight; the level at which that ends follows from the sources in order of their limit.
    """
    by_source = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("size").cast("double")).alias("square")
    )
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))) + 1)
    cap = F.col("source_size") * F.lit(float(most))
    order = Window.orderBy("limit", F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(rest)
    return (
        by_source.withColumns({"weight": weight, "cap": cap})
        .withColumn("limit", F.col("cap") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("limit"), F.col("level"))).over(everything))
        .select("source", "source_size", "square", F.least("cap", F.col("level") * F.col("weight")).alias("target"))
    )


def _tilted(most: float) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(50.0))))


def tilts(classes: DataFrame, goals: DataFrame, most: float) -> DataFrame:
    """goals with scale and tilt per source; null tilt: every document at its limit (or no words at all)."""
    open_ended = F.lit(None).cast("double")
    free = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * most * (1 - 1e-12))
    state = goals.select(
        "source",
        "source_size",
        "target",
        (F.col("square") / F.col("source_size")).alias("scale"),
        F.when(free, F.lit(0.0)).alias("tilt"),
        open_ended.alias("lo"),
        open_ended.alias("hi"),
        F.lit(False).alias("done"),
    )
    state = cut(state.drop("square"), "mix-state")
    for _ in range(STEPS):
        words = F.col("n") * F.col("size")
        rate = _tilted(most)
        slope = F.when(rate < most, words * rate * F.col("size") / F.col("scale")).otherwise(0.0)
        asked = state.where("tilt is not null and not done").select(F.col("source").alias("s"), "tilt", "scale")
        sums = (
            classes.join(asked, classes["source"].eqNullSafe(F.col("s")))
            .groupBy("s")
            .agg(F.sum(words * rate).alias("mixed"), F.sum(slope).alias("slope"))
        )
        stepped = state.join(sums, state["source"].eqNullSafe(F.col("s")), "left").drop("s")
        short = F.col("mixed") < F.col("target")
        lo = F.when(short, F.col("tilt")).otherwise(F.col("lo"))
        hi = F.when(short, F.col("hi")).otherwise(F.col("tilt"))
        newton = F.col("tilt") + F.log(F.col("target") / F.col("mixed")) * F.col("mixed") / F.col("slope")
        inside = F.coalesce(newton > F.col("lo"), F.lit(True)) & F.coalesce(newton < F.col("hi"), F.lit(True))
        # without a second bound, at least double the way from the first one
        away = F.abs("tilt") + 1.0
        fallback = (
            F.when(F.col("hi").isNull(), F.col("lo") + away)
            .when(F.col("lo").isNull(), F.col("hi") - away)
            .otherwise((F.col("lo") + F.col("hi")) / 2)
        )
        usable = F.coalesce((F.col("slope") > 0) & inside & (F.abs(newton - F.col("tilt")) <= 4 * away), F.lit(False))
        done = F.col("done") | F.coalesce(F.abs(F.col("mixed") / F.col("target") - 1) <= CLOSE, F.col("tilt").isNull())
        state = cut(
            stepped.withColumns({"lo": lo, "hi": hi, "done": done}).select(
                "source",
                "source_size",
                "target",
                "scale",
                F.when(F.col("done"), F.col("tilt")).otherwise(F.when(usable, newton).otherwise(fallback)).alias("tilt"),
                "lo",
                "hi",
                "done",
            ),
            "mix-state",
        )
        if state.where("not done").isEmpty():
            break
    return state


def plan(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken: a row for every row of ``docs``."""
    sized = cut(sizes(docs), "mix-sizes")
    classes = cut(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-classes")
    state = tilts(classes, cut(targets(sized, weights, most), "mix-targets"), most)

    known = state.withColumnRenamed("source", "s").drop("lo", "hi", "done")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("tilt").isNull(), F.lit(float(most))).otherwise(_tilted(most))
    zone = F.floor(F.log2(F.col("size") + F.lit(1.0)) * ZONES)
    rated = classes.join(known, classes["source"].eqNullSafe(F.col("s"))).drop("s").withColumns(
        {"units": F.round(rate * ONE).cast("long"), "zone": zone}
    )
    rated = cut(rated.withColumn("all_units", F.col("n") * F.col("units")), "mix-rated")
    earlier = Window.unboundedPreceding, -1
    zones = (
        rated.groupBy("source", "zone")
        .agg(F.sum("all_units").alias("z"))
        .withColumn("z", F.coalesce(F.sum("z").over(Window.partitionBy("source").orderBy("zone").rowsBetween(*earlier)), F.lit(0)))
        .select(F.col("source").alias("zs"), F.col("zone").alias("zz"), "z")
    )
    in_zone = Window.partitionBy("source", "zone").orderBy("size").rowsBetween(*earlier)
    placed = (
        rated.withColumn("c", F.coalesce(F.sum("all_units").over(in_zone), F.lit(0)))
        .join(zones, F.col("source").eqNullSafe(F.col("zs")) & (F.col("zone") == F.col("zz")))
        .select("source", "size", "source_size", "target", "units", (F.col("z") + F.col("c")).alias("start"))
    )
    numbered = ranked(sized, ["source", "size"], ["doc_id"], sized.count(), along=placed)
    numbered = cut(numbered.withColumn("from", F.col("start") + F.col("rank") * F.col("units")), "mix-numbered")

    def rounded(offset: Column) -> Column:
        first = F.col("from") + offset
        return F.shiftright(first + F.col("units"), SHIFT) - F.shiftright(first, SHIFT)

    # every offset rounds alike; a source takes the one that brings it nearest to its target
    offsets = [F.lit(k * ONE // OFFSETS) for k in range(OFFSETS)]
    tried = numbered.groupBy("source").agg(
        F.first("target").alias("target"), *[F.sum(rounded(o) * F.col("size")).alias(f"w{k}") for k, o in enumerate(offsets)]
    )
    misses = F.array(*[F.struct(F.abs(F.col(f"w{k}") - F.col("target")).alias("miss"), o.alias("offset")) for k, o in enumerate(offsets)])
    best = cut(tried.select(F.col("source").alias("s"), F.array_min(misses)["offset"].alias("offset")), "mix-offsets")
    chosen = numbered.join(best, numbered["source"].eqNullSafe(best["s"]))
    copies = rounded(F.col("offset"))
    return chosen.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("units") / ONE).alias("rate"),
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def mixed(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; rows of one document share its larger number of copies."""
    copies = plan(docs, weights, most).groupBy("doc_id", "source").agg(F.max("copies").alias("copies"))
    copies = copies.where("copies > 0")
    rows = docs.select(F.struct("*").alias("row"))
    same = rows["row.doc_id"].eqNullSafe(copies["doc_id"]) & rows["row.source"].cast("string").eqNullSafe(copies["source"])
    again = rows.join(copies, same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return again.select("row.*")
