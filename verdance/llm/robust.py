"""Quality rules: text statistics, two plain rules, and robust multivariate outliers per language and source.

Statistics come from the whole text. The documents that pass the plain rules are described by a vector of transformed
statistics (``VECTOR``). For every group of a language and a source the minimum-covariance-determinant estimate gives a
centre and a covariance that the outlying quarter of the group can't move; a document is rejected if its squared
Mahalanobis distance passes ``CUTOFF``.

The estimate starts from medians and median deviations and takes ``STEPS`` concentration steps. A step needs one
aggregation: documents are counted by group and distance bin together with their moments, and the moments of the bins
that hold the nearest ``CORE`` of the group are the next estimate. So a group, however large, is reduced in its tasks
to a row per bin. ``FLOOR`` is the spread that a statistic is granted at least, about the smallest difference it can tell
in a short document: a group of near-identical documents rejects nobody for that. A larger spread gets nothing added.

Groups under ``LEAST`` documents are pooled by language, and what then is still under it over all languages; a pool
under it judges nobody. Null text: no words, base_failed. Null language or source: a group of its own. Repeated rows
count each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdance.llm import textbytes as tb
from verdance.llm.common import cut

LEAST = 40
CORE = 0.75
STEPS = 6
#: Squared distance that a document may have: 99.99 % quantile of the chi-squared distribution with five degrees of freedom.
CUTOFF = 25.7448
#: 75 % quantile of the chi-squared distribution with five degrees of freedom, to which the core is scaled.
_CORE_QUANTILE = 6.6257
#: Bins of a statistic, and of the logarithm of a distance, for medians and quantiles.
_BIN = 1 / 64

SYMBOLS = b"#*$%&|<>"

#: The transformed statistics and the least spread of each.
VECTOR = {
    "ln(n_words)": 0.1,
    "ln(word_chars / n_words)": 0.1,
    "ln(1 + 100 * n_symbols / n_words)": 0.4,
    "ln(1 + 100 * n_dup_lines / n_words)": 0.4,
    "ln(1 + 100 * n_repeat_words / n_words)": 0.58,
}
FLOOR = np.array(list(VECTOR.values()))
P = len(FLOOR)
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _slice_stats(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    rows = len(offsets) - 1

    def per_row(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])

    sums = tb.prefix_hash(buf)
    start, end, row = tb.word_spans(buf, offsets)
    in_row = np.arange(rows, dtype=np.uint64)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True

    # lines: cut at every line feed and at the texts' ends
    first = np.unique(np.concatenate((offsets, np.flatnonzero(buf == 10) + 1)))
    last = np.append(first[1:], len(buf))[: len(first)]
    first, last = first[first < len(buf)], last[first < len(buf)]
    line_row = np.searchsorted(offsets, first, "right") - 1
    closed = last - (buf[last - 1] == 10)
    worded = np.searchsorted(start, last) > np.searchsorted(start, first)
    key = tb.mix(tb.span_hash(sums, first, closed) ^ tb.mix(in_row[line_row]))
    worded_rows = line_row[worded]
    _, at = np.unique(key[worded], return_index=True)
    dup_lines = np.bincount(worded_rows, minlength=rows) - np.bincount(worded_rows[at], minlength=rows)

    # words inside five-word windows that the text has more than once
    words = tb.span_hash(sums, start, end)
    grams = tb.gram_hash(words, 5)
    whole = np.flatnonzero(row[: len(grams)] == row[4:]) if len(grams) else np.zeros(0, int)
    _, which, count = np.unique(
        tb.mix(grams[whole] ^ tb.mix(in_row[row[whole]])), return_inverse=True, return_counts=True
    )
    again = whole[count[which] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + 5, -1)
    covered = np.cumsum(edge)[:-1] > 0
    return {
        "n_words": np.bincount(row, minlength=rows),
        "word_chars": per_row(~tb.SPACE[buf] & ((buf & 0xC0) != 0x80)),
        "n_symbols": per_row(symbol[buf]),
        "n_dup_lines": dup_lines,
        "n_repeat_words": np.bincount(row[covered], minlength=rows),
    }


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the five statistics of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_slice_stats(buf, offsets) for _, _, buf, offsets in tb.slices(batch.column("text"))]
            found = {s: pa.array(np.concatenate([p[s] for p in parts]) if parts else [], pa.int64()) for s in STATS}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("doc_id", "lang", "source")} | found)

    schema = "doc_id long, lang string, source string, " + ", ".join(f"{s} long" for s in STATS)
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    return docs.select(doc_id, text.alias("text"), F.col("lang").cast("string"), F.col("source").cast("string")).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _grouped(stats: DataFrame) -> DataFrame:
    """``stats`` with the group that judges a document (null: none)."""
    counts = stats.where("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang, everything = Window.partitionBy("lang", "small"), Window.partitionBy("small", "tiny")
    level = (
        counts.withColumn("small", F.col("n") < LEAST)
        .withColumn("tiny", F.sum("n").over(by_lang) < LEAST)
        .withColumn("none", F.sum("n").over(everything) < LEAST)
    )
    named = F.to_json(
        F.when(~F.col("small"), F.struct(F.lit(1).alias("level"), "lang", "source")).otherwise(
            F.struct(F.when(F.col("tiny"), 3).otherwise(2).alias("level"), F.when(~F.col("tiny"), F.col("lang")).alias("lang"), F.lit(None).cast("string").alias("source"))
        )
    )
    names = level.select(
        F.col("lang").alias("l"),
        F.col("source").alias("s"),
        F.when(~(F.col("small") & F.col("tiny") & F.col("none")), named).alias("group"),
    )
    names = cut(names, "robust-names")
    same = stats["lang"].eqNullSafe(names["l"]) & stats["source"].eqNullSafe(names["s"])
    return stats.join(names, same, "left").drop("l", "s")


def _start(vectors: DataFrame) -> DataFrame:
    """group, centre, white: medians and median deviations; ``white`` turns a difference into unit coordinates."""

    def median(of: DataFrame) -> DataFrame:
        up_to = Window.partitionBy("group", "k").orderBy("bin")
        half = Window.partitionBy("group", "k")
        counted = of.groupBy("group", "k", F.round(F.col("value") / _BIN).cast("long").alias("bin")).agg(F.count("*").alias("n"))
        reached = counted.withColumns({"c": F.sum("n").over(up_to), "all": F.sum("n").over(half)}).where("2 * c >= all")
        return reached.groupBy("group", "k").agg((F.min("bin") * _BIN).alias("median"))

    tall = vectors.select("group", F.posexplode("x").alias("k", "value"))
    centre = cut(median(tall), "robust-centre").select(F.col("group").alias("g"), F.col("k").alias("kk"), "median")
    away = tall.join(centre, (F.col("group") == F.col("g")) & (F.col("k") == F.col("kk"))).select(
        "group", "k", F.abs(F.col("value") - F.col("median")).alias("value")
    )
    spread = median(away).withColumnRenamed("median", "mad").join(
        centre, (F.col("group") == F.col("g")) & (F.col("k") == F.col("kk"))
    )
    ordered = F.sort_array(F.collect_list(F.struct("k", "median", "mad")))  # one entry a statistic
    return spread.groupBy("group").agg(ordered.alias("s")).select("group", F.col("s.median").alias("centre"), F.col("s.mad").alias("mad"))


def _white(cov: np.ndarray) -> np.ndarray:
    """Turns a difference into unit coordinates of ``cov``, whose axes get the least spread where theirs is smaller."""
    values, axes = np.linalg.eigh(cov / np.outer(FLOOR, FLOOR))
    wide = (axes * np.maximum(values, 1.0)) @ axes.T * np.outer(FLOOR, FLOOR)
    return np.linalg.inv(np.linalg.cholesky(wide)).ravel()


def _white_of_mad(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        white = [_white(np.diag((1.4826 * np.array(m)) ** 2)) for m in b["mad"]]
        yield pd.DataFrame({"group": b["group"], "centre": b["centre"], "white": white, "scale": 1.0})


def _white_of_moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            centre, cov = np.array(r.sums) / r.n, np.zeros((P, P))
            for (i, j), s in zip(_PAIRS, r.products, strict=True):
                cov[i, j] = cov[j, i] = s / r.n - centre[i] * centre[j]
            # the edge was measured with the last step's scale in it
            scale = max(1.0, r.scale * r.edge / _CORE_QUANTILE)
            out.append((r.group, centre, _white(cov * scale), scale))
        yield pd.DataFrame(out, columns=["group", "centre", "white", "scale"])


def _distance() -> Column:
    """Squared distance of ``x`` from ``centre`` in the coordinates of ``white`` (lower triangular)."""
    turned = [
        " + ".join(f"white[{i * P + j}] * (x[{j}] - centre[{j}])" for j in range(i + 1)) for i in range(P)
    ]
    return F.expr(" + ".join(f"pow({t}, 2)" for t in turned))


_MODEL = "group string, centre array<double>, white array<double>, scale double"


def estimates(vectors: DataFrame) -> DataFrame:
    """group, centre, white by minimum covariance determinant, for vectors (group, x)."""
    model = cut(_start(vectors).mapInPandas(_white_of_mad, _MODEL), "robust-model")
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(P)]
    products = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i, j in _PAIRS]
    for _ in range(STEPS):
        near = vectors.join(model, "group").withColumn("d", _distance())
        near = near.withColumn("bin", F.floor(F.ln(F.greatest("d", F.lit(1e-6))) / _BIN))
        binned = near.groupBy("group", "bin").agg(F.count("*").alias("n"), F.max("d").alias("far"), F.max("scale").alias("scale"), *sums, *products)
        up_to = Window.partitionBy("group").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy("group")
        core = binned.withColumns(
            {"before": F.coalesce(F.sum("n").over(up_to), F.lit(0)), "all": F.sum("n").over(whole)}
        ).where(F.col("before") < CORE * F.col("all"))
        moments = core.groupBy("group").agg(
            F.sum("n").alias("n"),
            F.max("far").alias("edge"),
            F.max("scale").alias("scale"),
            F.array(*[F.sum(f"s{i}") for i in range(P)]).alias("sums"),
            F.array(*[F.sum(f"p{i}_{j}") for i, j in _PAIRS]).alias("products"),
        )
        model = cut(moments.mapInPandas(_white_of_moments, _MODEL), "robust-model")
    return model


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, distance (null: not judged) and kept, a row for every row of ``docs``."""
    stats = cut(statistics(docs).withColumn("base_failed", base_failed()), "robust-stats")
    vector = F.when(~F.col("base_failed"), F.array(*[F.expr(v) for v in VECTOR]))
    grouped = cut(_grouped(stats).withColumn("x", vector), "robust-grouped")
    model = estimates(grouped.where("not base_failed and group is not null").select("group", "x"))
    scored = grouped.join(model, "group", "left").withColumn(
        "distance", F.when(~F.col("base_failed"), _distance())
    )
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return scored.select("doc_id", *STATS, "base_failed", "distance", kept.alias("kept"))
