"""Best-fit packing by minimum bin slack.

Only lengths matter for a packing, and a length is at most the limit: the table of lengths has at most ``limit`` rows
however many pieces there are. Over that table a bin is filled at a time. It starts with the longest length left, and a
subset-sum dynamic program over the lengths available, one bit per sum, finds the fullest feasible combination. The bin
is then taken as often as the counts allow, so there are about as many different bins as lengths. The bins become slots
per length; a piece takes the slot of its rank among the pieces of its length. Ranks are dealt over cells, so a length
that a third of all pieces share is not a task of its own.

A null or empty text is one piece that holds the end id alone. Rows that share a doc_id, or have none, are packed each.
An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.llm.common import cut, ranked
from verdance.llm.tokens import word_ids

#: Tokens of a sequence.
LIMIT = 4096
#: Id behind each document's own ids.
END = 1
#: Characters of text that are split into words at once.
_CHUNK = 1 << 19


def tokenized(docs: DataFrame, path: str, limit: int = LIMIT, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and with ``ids`` the little-endian 32-bit ids of every piece."""
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_ids(path)
        for batch in batches:
            texts, rows, data = batch.column("text").fill_null("").to_pylist(), [], []
            lo = 0
            while lo < len(texts):
                hi, held = lo, 0
                while hi < len(texts) and (hi == lo or held + len(texts[hi]) <= _CHUNK):
                    held += len(texts[hi])
                    hi += 1
                for row, got in zip(range(lo, hi), own.encode(texts[lo:hi]), strict=True):
                    got += end
                    for piece, at in enumerate(range(0, len(got), 4 * limit)):
                        part = got[at : at + 4 * limit]
                        rows.append((row, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                        if ids:
                            data.append(part)
                lo = hi
            row, piece, start, length, crc = map(np.array, zip(*rows, strict=True)) if rows else [np.zeros(0, int)] * 5
            arrays = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())]
            arrays += [pa.array(c, pa.int64()) for c in (start, length, crc)]
            arrays += [pa.array(data, pa.binary())] * ids
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths whose sum comes closest to ``room`` from below, each at most as often as ``counts`` says."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        for _ in range(min(counts[length], room // length)):
            grown = (reach | reach << length) & mask
            if grown == reach:
                break
            steps.append((length, reach))
            reach = grown
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> at & 1:
            taken.append(length)
            at -= length
    return taken


def bins(counts: dict[int, int], limit: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, longest first; how many such bins) until nothing is left."""
    left, out = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        inside = [longest, *sorted(fullest(left, limit - longest), reverse=True)]
        left[longest] += 1
        uses = {x: inside.count(x) for x in inside}
        times = min(left[x] // n for x, n in uses.items())
        for x, n in uses.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((inside, times))
    return out


def slots(counts: dict[int, int], limit: int) -> np.ndarray:
    """Columns length, first rank, uses in a bin, first sequence, first offset; ordered by length and rank."""
    rows, sequence, given = [], 0, dict.fromkeys(counts, 0)
    for inside, times in bins(counts, limit):
        offset = 0
        for length in dict.fromkeys(inside):
            uses = inside.count(length)
            rows.append((length, given[length], uses, sequence, offset))
            given[length] += uses * times
            offset += uses * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def packed(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``pieces`` (doc_id, piece, length of 1 to ``limit``, ...) with sequence_id and offset."""
    pieces = cut(pieces, "pack-pieces")
    names = pieces.columns
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = slots(counts, limit)  # bounded by the limit
    numbered = ranked(pieces, ["length"], ["doc_id", "piece"], sum(counts.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = plan[:, 0] << 48 | plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            own = plan[np.searchsorted(key, length << 48 | rank, "right") - 1]
            place = rank - own[:, 1]
            columns = {c: batch.column(c) for c in names}
            columns["sequence_id"] = pa.array(own[:, 3] + place // own[:, 2])
            columns["offset"] = pa.array(own[:, 4] + place % own[:, 2] * length)
            yield pa.RecordBatch.from_pydict(columns)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields]
    return numbered.mapInArrow(run, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack(docs: DataFrame, path: str, limit: int = LIMIT, ids: bool = False) -> DataFrame:
    """Every document's pieces with their place in a sequence."""
    return packed(tokenized(docs, path, limit, ids), limit)
