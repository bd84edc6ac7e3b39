"""Removal of every byte that a repeated string of ``LENGTH`` bytes covers.

The method is suffix sorting over a difference cover, to the depth that decides: sample places so that equal strings
are sampled alike, name the sampled places' contexts, place all other suffixes by the sampled place they lead to, and
compare suffixes that come together. The cover is taken from the content (a synchronizing set) and not from place
numbers modulo a constant: of the ``GRAM``-byte strings inside a window of ``LENGTH`` bytes, the one with the least hash is
its anchor. Equal windows have their anchor at the same place, so they meet under one name; and only one place in some
140 is sampled where residues modulo 3 would sample two in three.

1. Every anchor owns the successive window starts that it is the anchor of. Its context is all bytes of those windows.
   Anchors are grouped by gram; a gram with one place has no repeated window.
2. If all contexts of a gram are equal, all of its windows are repeated. That settles the inside of copies.
3. In the other grams equal contexts are named the same. What is still unsettled are contexts seen once, at the edges
   of copies. They are split into cells of starts, ``CELLS``, step by step down to one start: a cell whose bytes occur
   again is repeated; a cell whose common core occurs once holds no repeated window; the rest is split on.
4. The ranges found are merged per document and cut out.

Names are hashes: a wrong match would need two equal 64-bit hashes under one equal 64-bit gram hash.

Groups are only ever counted, never gathered; what is gathered belongs to one document. A null text is empty. Rows with
the same doc_id and text are copies of each other; rows with the same doc_id and other text are told apart by a hash of
the text. A null doc_id is as good as any. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdance.llm import textbytes as tb
from verdance.llm.common import cut

LENGTH, GRAM = 400, 32
#: Window starts of a cell, step by step; each divides the one before, the first divides SPAN.
CELLS = (24, 1)
#: Window starts that an anchor can own, rounded up.
SPAN = 384
_REACH = LENGTH - GRAM + 1
#: Bytes of text handled at once, so that the arrays over them stay in a core's cache.
_SLICE = 1 << 16
#: Anchors that leave a task at once.
_ROWS = 1 << 16
_KEY = ["d", "h"]
U64 = np.uint64
_HALF = U64(31)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` successive values: minima of 2, 4, 8, ... values, the last step overlaps."""
    size, least = 1, values
    while size < width:
        step = min(size, width - size)
        least, size = np.minimum(least[:-step], least[step:]), size + step
    return least


def anchors(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray] | None:
    """row, first and last owned start, place, gram and context hash of all anchors of some texts."""
    n = len(buf)
    if n < LENGTH:
        return None
    sums = tb.prefix_hash(buf)
    # in order of the hash's upper half, then of the place
    order = tb.span_sums(sums, GRAM)
    order >>= _HALF
    order <<= _HALF
    order |= np.arange(len(order), dtype=U64)
    least = _least(order, _REACH)
    # the place of the least changes, or a row begins; the windows that end behind their row go
    begins = offsets[:-1][offsets[:-1] < len(least)]
    first = np.union1d(begins, np.flatnonzero(least[1:] != least[:-1]) + 1)
    row = np.searchsorted(offsets, first, "right") - 1
    last = np.minimum(np.append(first[1:], len(least)) - 1, offsets[row + 1] - LENGTH)
    inside = first <= last
    first, last, row = first[inside], last[inside], row[inside]
    if not len(first):
        return None
    at = (least[first] & U64(2**31 - 1)).astype(np.int64)
    gram = tb.span_hash(sums, at, at + GRAM)
    context = tb.mix(tb.span_hash(sums, first, last + LENGTH) + (at - first).astype(U64))
    base = offsets[row]
    return {"row": row, "a": first - base, "b": last - base, "p": at - base, "g": gram, "c": context}


def _of_slice(buf: np.ndarray, offsets: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
    """Anchors of a slice; a text longer than a slice goes in stretches of window starts."""
    if len(offsets) > 2 or len(buf) <= 2 * _SLICE:
        found = anchors(buf, offsets)
        if found is not None:
            yield found
        return
    for lo in range(0, len(buf) - LENGTH + 1, _SLICE):
        part = buf[lo : lo + _SLICE + LENGTH - 1]
        found = anchors(part, np.array([0, len(part)]))
        if found is not None:
            yield found | {k: found[k] + lo for k in ("a", "b", "p")}


def _packed(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    return a << 18 | (b - a) << 9 | (p - a)


def _unpacked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = x >> 18
    return a, a + (x >> 9 & 511), a + (x & 511)


def sampled(docs: DataFrame) -> DataFrame:
    """(d, h, x, g, c, w): anchors with their packed place, once for each different context of a document.

    A context that a document has more than once has w = 2 and is followed by its ranges as rows without a gram.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, h = (batch.column(k).to_numpy(zero_copy_only=False) for k in _KEY)
            held: list[dict[str, np.ndarray]] = []
            for lo, _, buf, offsets in tb.slices(batch.column("text"), _SLICE):
                for found in _of_slice(buf, offsets):
                    held.append(found | {"row": found["row"] + lo})
                    if sum(len(f["row"]) for f in held) >= _ROWS:
                        yield from packed(d, h, held)
                        held = []
            if held:
                yield from packed(d, h, held)

    def packed(d: np.ndarray, h: np.ndarray, held: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        found = {k: np.concatenate([f[k] for f in held]) for k in held[0]}
        x, row = _packed(found["a"], found["b"], found["p"]), found["row"]
        order = np.lexsort((found["a"], found["c"], found["g"], row))
        x, row, g, c = x[order], row[order], found["g"][order], found["c"][order]
        same = np.concatenate(([False], (row[1:] == row[:-1]) & (g[1:] == g[:-1]) & (c[1:] == c[:-1]), [False]))
        head, again = ~same[:-1], same[1:]
        w = np.where(head & again, 2, 1)[head]
        yield rows(d[row[head]], h[row[head]], x[head], g[head], c[head], w)
        local = same[:-1] | again
        if local.any():
            zero = np.zeros(int(local.sum()), U64)
            yield rows(d[row[local]], h[row[local]], x[local], zero, zero, np.zeros(len(zero), int))

    def rows(*columns: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.array(col.view(np.int64) if col.dtype == U64 else col.astype(np.int64)) for col in columns]
        return pa.RecordBatch.from_arrays(arrays, names=["d", "h", "x", "g", "c", "w"])

    return docs.select(*_KEY, "text").mapInArrow(run, "d long, h long, x long, g long, c long, w long")


def _listed(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of a document as lists."""
    return rows.groupBy(*_KEY).agg(*[F.collect_list(c).alias(c) for c in columns])


def contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (d, h, x, g, settled) with the bytes of the context; equal documents come once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                text = part.column("text").cast(pa.binary())[0].as_py()
                x, g = (part.column(n).flatten().to_numpy() for n in ("x", "g"))
                settled = part.column("settled").flatten()
                a, b, _ = _unpacked(x)
                for lo in range(0, len(x), 4096):
                    own = slice(lo, lo + 4096)
                    data = [text[i : j + LENGTH] for i, j in zip(a[own].tolist(), b[own].tolist(), strict=True)]
                    ids = [pa.array(np.full(len(data), part.column(n)[0].as_py(), np.int64)) for n in _KEY]
                    arrays = [*ids, pa.array(x[own]), pa.array(g[own]), settled.slice(lo, 4096), pa.array(data, pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=[*_KEY, "x", "g", "settled", "data"])

    joined = docs.select(*_KEY, "text").join(_listed(wanted, "x", "g", "settled"), _KEY)
    schema = "d long, h long, x long, g long, settled boolean, data binary"
    return joined.select(*_KEY, "text", "x", "g", "settled").mapInArrow(run, schema)


def _cells(held: DataFrame, size: int) -> DataFrame:
    """(d, h, x, g, cell, lo, hi, core, full, settled): the cells of contexts; ``parts``, if there, says which.

    lo and hi are the starts owned in the cell; core hashes what all windows of the cell share, full the bytes of the
    starts owned.
    """
    names = [*_KEY, "x", "g", "cell", "lo", "hi", "core", "full", "settled"]
    limited = "parts" in held.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                yield split(batch.slice(lo, 2048))

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = batch.column("data")
        size_of = np.array([len(v) for v in data.to_pylist()], np.int64)
        base = np.concatenate(([0], np.cumsum(size_of)))
        buf = np.frombuffer(b"".join(data.to_pylist()), np.uint8)
        sums = tb.prefix_hash(buf)
        x = batch.column("x").to_numpy()
        a, b, p = _unpacked(x)
        first, last = (a - p + SPAN) // size, (b - p + SPAN) // size
        count = last - first + 1
        row = np.repeat(np.arange(len(x)), count)
        cell = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
        if limited:
            parts = batch.column("parts")
            owner = np.repeat(np.arange(len(x)), np.diff(parts.offsets.to_numpy()))
            wanted = owner * (1 << 20) + parts.flatten().to_numpy()
            keep = np.isin(row * (1 << 20) + cell * size // step, wanted)
            row, cell = row[keep], cell[keep]
        lo = np.maximum(a[row], p[row] + cell * size - SPAN)
        hi = np.minimum(b[row], p[row] + (cell + 1) * size - 1 - SPAN)
        zero = base[row] - a[row]  # text place 0 in the buffer
        shared = zero + p[row] + cell * size - SPAN
        core = tb.span_hash(sums, shared + size - 1, shared + LENGTH)
        full = tb.mix(tb.span_hash(sums, zero + lo, zero + hi + LENGTH) + (lo - p[row] + SPAN).astype(U64))
        take = pa.array(row)
        arrays = [batch.column(n).take(take) for n in (*_KEY, "x", "g")]
        arrays += [pa.array(v) for v in (cell, lo, hi, core.view(np.int64), full.view(np.int64))]
        return pa.RecordBatch.from_arrays([*arrays, batch.column("settled").take(take)], names=names)

    step = CELLS[max(0, CELLS.index(size) - 1)]
    schema = "d long, h long, x long, g long, cell long, lo long, hi long, core long, full long, settled boolean"
    return held.mapInArrow(run, schema)


def _judged(cells: DataFrame, label: str) -> DataFrame:
    """``cells`` with whether their windows are repeated (null: not decided) and whether they go on."""
    at = ["g", "cell"]
    full = cells.groupBy(*at, "full").agg(
        F.count("*").alias("n"), F.min(F.struct(*_KEY, "x")).alias("first"), F.max("settled").alias("known")
    )
    core = cells.groupBy(*at, "core").agg(F.count("*").alias("sharing"))
    seen = cells.join(full, [*at, "full"]).join(core, [*at, "core"])
    repeated = F.when((F.col("n") > 1), True).when(F.col("sharing") == 1, False)
    leads = F.struct(*_KEY, "x") == F.col("first")
    seen = seen.withColumns({"repeated": repeated, "leads": leads})
    return cut(seen.select(*_KEY, "x", "g", "cell", "core", "lo", "hi", "settled", "repeated", "leads"), label)


def repeated_ranges(docs: DataFrame, once: DataFrame) -> DataFrame:
    """(d, h, lo, hi): starts whose windows are repeated, for documents (d, h, text); ``once`` has equal ones once."""
    anchored = cut(sampled(docs), "repeats-anchors")  # read three times, found once
    grams = (
        anchored.where("w > 0")
        .groupBy("g")
        .agg(F.sum("w").alias("n"), F.min("c").alias("low"), F.max("c").alias("high"))
        .where("n > 1")
    )
    grouped = anchored.where("w > 0").join(grams, "g")
    grouped = cut(grouped.select(*_KEY, "x", "g", "c", "w", (F.col("low") == F.col("high")).alias("alike")), "repeats-grams")
    a, last = F.shiftright("x", 18), F.shiftright("x", 18) + F.shiftright("x", 9).bitwiseAND(F.lit(511))
    as_range = [*_KEY, a.alias("lo"), last.alias("hi")]
    found = [anchored.where("w = 0").select(*as_range), grouped.where("alike").select(*as_range)]

    mixed = grouped.where("not alike")
    named = mixed.groupBy("g", "c").agg(F.sum("w").alias("n"), F.min(F.struct(*_KEY, "x")).alias("first"))
    seen = mixed.join(named, ["g", "c"]).withColumn("settled", F.col("n") > 1)
    seen = cut(seen.withColumn("leads", F.struct(*_KEY, "x") == F.col("first")), "repeats-named")
    found.append(seen.where("settled").select(*as_range))
    open_grams = seen.where("not settled").select("g").distinct()
    wanted = seen.where("leads").join(open_grams, "g", "left_semi").select(*_KEY, "x", "g", "settled").distinct()
    held = cut(contexts(once, wanted), "repeats-contexts")

    parts = held
    for k, size in enumerate(CELLS):
        cells = _judged(_cells(parts, size), f"repeats-cells{size}")
        found.append(cells.where("repeated and not settled").select(*_KEY, "lo", "hi"))
        if k + 1 == len(CELLS):
            break
        undecided = cells.where("repeated is null and not settled").select("g", "cell", "core").distinct()
        onward = cells.where("leads").join(undecided, ["g", "cell", "core"], "left_semi")
        marked = onward.groupBy(*_KEY, "x", "g").agg(
            F.collect_set("cell").alias("parts"),
        )
        parts = held.join(marked, [*_KEY, "x", "g"]).select(*held.columns, "parts")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def _covers(text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged byte ranges [start, end) of windows that start in [lo, hi]."""
    order = np.argsort(lo, kind="stable")
    start, end = lo[order], np.maximum.accumulate(hi[order] + LENGTH)
    new = np.concatenate(([True], start[1:] > end[:-1]))
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def without_repeats(docs: DataFrame, text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``text`` the bytes that are left."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shared = not ids.groupBy("doc_id").count().where("count > 1").isEmpty()
    tell: Column = F.xxhash64("text") if shared else F.lit(0).cast("long")
    keyed = ids.withColumns({"d": F.coalesce("doc_id", F.lit(-(2**63))), "h": tell})
    once = keyed.dropDuplicates(_KEY) if shared else keyed
    ranges = _listed(repeated_ranges(keyed, once), "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, out = {n: batch.column(n) for n in ("lo", "hi")}, []
            for k in range(batch.num_rows):
                data = batch.column("text").slice(k, 1).cast(pa.binary())[0].as_py()
                removed = spans = 0
                left = [data]
                if lists["lo"][k].is_valid:
                    lo, hi = (lists[n].slice(k, 1).flatten().to_numpy() for n in ("lo", "hi"))
                    start, end = _covers(data, lo, hi)
                    spans, removed = len(start), int((end - start).sum())
                    ends, starts = [0, *end.tolist()], [*start.tolist(), len(data)]
                    left = [data[i:j] for i, j in zip(ends, starts, strict=True)]
                kept = b"".join(left)
                out.append((len(data), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            arrays = [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())]
            arrays += [pa.array(columns[4], pa.binary())] * text
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * text]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * text
    return keyed.join(ranges, _KEY, "left").select("doc_id", "text", "lo", "hi").mapInArrow(run, schema)
