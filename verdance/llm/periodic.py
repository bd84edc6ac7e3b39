"""Periodic run detection over the words of a text: an online sparse diagonal dynamic program.

A diagonal is a lag: word i stands on diagonal q if it equals word i - q. Each word looks at its earlier occurrences,
lengthens the matches of their diagonals by one, and a diagonal that ends with enough matches emits a run. A run is a
longest stretch of words with smallest period q and at least ``max(LEAST, TIMES * q)`` words.

Looking at every earlier occurrence is quadratic in a text that says one word over and over. So a place is named by
the words that follow it, in windows of 16, 32, 64, ... words, and a window of k words serves the lags over k / 2 up to
k (the first one all lags up to 16). In a run with such a lag q every window is followed by its copy q words on, and no
nearer copy can exist: two periods of at most k in a stretch of k words and more would leave a common smaller one, and
q is the smallest. So one earlier occurrence, the nearest, is all that a place has to look at: the matches of a
diagonal are places in a row with the same lag, and the result is exact with O(n log n) work for any text. Windows grow
until no window of a text occurs twice.

A null text has no words; an empty text, or one of white space, has no run and collapses to the empty string. Rows that
share a doc_id, or have none, are judged each on its own; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdance.llm.textbytes import U64, mix

#: Words that a run has at least, and how often it holds its period at least.
LEAST, TIMES = 24, 3
#: Words of the first window; a run of LEAST words and a lag of at most WINDOW holds one.
WINDOW = 16
#: Words that are searched at once; a longer text is searched alone.
_WORDS = 1 << 17

_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def find(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs, ordered by start and period.

    ``ids`` are the words of texts one behind another, ``offsets`` the texts' bounds; runs don't cross texts.
    """
    places = np.arange(len(ids))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    end = offsets[1:][text]
    # the text is part of the name, so that nothing matches another text
    name = mix(ids.astype(U64) + mix(text.astype(U64) + U64(1)))
    width, found = 1, []
    while len(places):
        if width >= WINDOW:
            lag = _nearest_of(name, places)
            least = 1 if width == WINDOW else width // 2 + 1
            on = (lag >= least) & (lag <= width)
            at, lags = places[on], lag[on]
            first = np.ones(len(at), bool)
            first[1:] = (np.diff(at) != 1) | (np.diff(lags) != 0)
            last = np.append(first[1:], True)[: len(at)]
            start, period = at[first] - lags[first], lags[first]
            length = at[last] + width - start
            good = length >= np.maximum(LEAST, TIMES * period)
            found.append((start[good], length[good], period[good]))
            # a longer window that occurs twice begins with one that does
            repeated = np.zeros(len(ids), bool)
            repeated[places[lag > 0]] = True
            repeated[places[lag > 0] - lag[lag > 0]] = True
            places = places[repeated[places]]
        # windows of twice the width, where a lag over the width could still fit three times into the text
        places = places[(places + 2 * width <= end[places])]
        if width >= WINDOW:
            places = places[(end - offsets[:-1][text])[places] >= TIMES * (width + 1)]
        longer = np.zeros(len(ids), U64)
        longer[places] = mix(name[places] * U64(0x9E3779B97F4A7C15) + name[places + width])
        name, width = longer, 2 * width
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _nearest_of(name: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each of the rising ``places`` the distance to the nearest earlier one with the same name, or 0."""
    own = name[places]
    order = np.argsort(own, kind="stable")
    same = own[order[1:]] == own[order[:-1]]
    out = np.zeros(len(places), np.int64)
    out[order[1:][same]] = (places[order[1:]] - places[order[:-1]])[same]
    return out


def _searched(texts: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The runs of each text, given as words; starts count from the text's first word."""
    known: dict[bytes, int] = {}
    number, fresh = known.setdefault, count()
    ids = np.fromiter((number(w, next(fresh)) for words in texts for w in words), np.int64)
    offsets = np.concatenate(([0], np.cumsum([len(words) for words in texts])))
    start, length, period = find(ids, offsets)
    cuts = np.searchsorted(start, offsets)
    for k in range(len(texts)):
        own = slice(cuts[k], cuts[k + 1])
        yield start[own] - offsets[k], length[own], period[own]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (by start, then period) and collapsed.

    ``collapsed`` has the words that stay, one space between them: of every run, the words behind its first period go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, held, size = 0, [], 0
            for hi in range(batch.num_rows + 1):
                if hi == batch.num_rows or size > _WORDS:
                    if held:
                        yield answer(batch.column("doc_id").slice(lo, len(held)), held)
                    lo, held, size = hi, [], 0
                if hi < batch.num_rows:
                    held.append((batch.column("text")[hi].as_py() or "").encode().split())
                    size += len(held[-1])

    def answer(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        bounds, columns, collapsed = [0], ([], [], []), []
        for words, own in zip(texts, _searched(texts), strict=True):
            start, length, period = own
            bounds.append(bounds[-1] + len(start))
            for column, part in zip(columns, own, strict=True):
                column.append(part)
            if len(start):
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, start + period, 1)
                np.add.at(change, start + length, -1)
                words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
            collapsed.append(b" ".join(words))
        start, length, period = (pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in columns)
        runs = pa.StructArray.from_arrays([start, length, period], names=["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs)
        return pa.RecordBatch.from_arrays([ids, lists, pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, f"doc_id long, runs {_RUNS}, collapsed string")


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    parts = F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, a tenth of the texts made periodic from some word on.

    With h the CRC-32 of the doc_id as text and g = h div 10, a text whose h is a multiple of 10 goes on from word
    a = g mod n with the words from there up to p = 1 + (n - a) div (3 + g mod 8), over and over. Without a doc_id a
    text stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h"))
    words = F.when(F.col("h") % 10 == 0, words_of(F.col("text")))
    shaped = keyed.select("doc_id", "text", F.floor(F.col("h") / 10).alias("g"), words.alias("w"))
    shaped = shaped.withColumn("n", F.coalesce(F.size("w"), F.lit(0)).cast("long"))
    shaped = shaped.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    shaped = shaped.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    period = F.slice("w", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(period, times)), F.lit(1), (F.col("n") - F.col("a")).cast("int"))
    head = F.slice("w", F.lit(1), F.col("a").cast("int"))
    periodic = F.array_join(F.concat(head, tail), " ")
    return shaped.select("doc_id", F.when(F.col("n") > 0, periodic).otherwise(F.col("text")).alias("text"))


def digest(docs: DataFrame) -> DataFrame:
    """Per row: n_runs, the run with the greatest length / period, hashes of all runs and of the collapsed text."""
    found = periodic_runs(docs)
    # the greatest exact quotient: cross products, so that no division decides
    better = lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda a, b: F.when(a.isNull(), b).otherwise(better(a, b)))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
