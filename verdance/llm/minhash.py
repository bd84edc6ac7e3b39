"""Near duplicates by b-bit MinHash: bands propose, packed low bits estimate, full shingle sets decide.

A text's set holds its distinct word shingles (ASCII letters folded); a text with fewer words than a shingle is one
shingle as a whole, a text without words has the empty set and is linked with nothing. Two documents are linked if
their sets' Jaccard similarity reaches the threshold; groups are the connected components of the links.

* Equal sets are one node from the start, so groups of exact copies never meet each other.
* Documents that share a bucket of some band are candidates. The band count is such that a pair at the threshold
  misses every band with a probability below ``MISS``.
* In each bucket all members are first compared with its hub, the member in most company over all its buckets. That
  is one comparison a member, and it joins most of a group of copies. What is left are pairs of one bucket that
  lie in different components: those are compared block by block inside tasks, by longer packed signatures and the
  known distances to a common hub. In ``BEST_ROUNDS`` rounds each member's best partner alone is confirmed, again one
  comparison a member; then all pairs that are still apart and may reach the threshold are.
* Every link is confirmed on the full sets. None of these steps has a cap.

Null or empty texts: empty set, own component. Rows that share a doc_id are one node (each row is returned); rows with
a null doc_id are linked with nothing and have a null component. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdance.llm import textbytes as tb
from verdance.llm.common import components, cut

#: Probability with which a pair at the threshold is in no common bucket.
MISS = 1e-7
#: Standard errors by which an estimate may fall short of the threshold.
SLACK = 4.0
#: Members of a bucket that are compared in one task, squared.
BLOCK = 256
#: Rounds in which only the best partner of each member is confirmed.
BEST_ROUNDS = 2

#: Hashes that are made at once, so that they stay in the cache.
_CELLS = 1 << 17

_SEED = np.random.Generator(np.random.PCG64(7))
_FLIP = _SEED.integers(0, 2**64, 4096, dtype=np.uint64)
_ODD = _SEED.integers(0, 2**64, 4096, dtype=np.uint64) | np.uint64(1)


@dataclass(frozen=True)
class Near:
    """words per shingle, similarity in percent, band rows, number of minima kept as ``bits`` low bits each.

    ``fine`` minima are kept of the documents that are compared block by block.
    """

    words: int = 5
    percent: int = 80
    rows: int = 4
    minima: int = 256
    bits: int = 4
    fine: int = 2048

    @property
    def bands(self) -> int:
        hit = (self.percent / 100) ** self.rows
        return math.ceil(math.log(MISS) / math.log1p(-min(hit, 1 - 1e-9)))

    def least_equal(self, minima: int) -> int:
        """Equal low bits that a pair at the threshold has at least, ``SLACK`` standard errors below the mean."""
        p = self.percent / 100
        p += (1 - p) * 2.0**-self.bits
        return max(0, math.floor(minima * p - SLACK * math.sqrt(minima * p * (1 - p))))

    def estimate(self, equal: Column) -> Column:
        """Similarity from the number of equal low bits, corrected for chance collisions."""
        chance = 2.0**-self.bits
        return (equal / F.lit(self.minima) - F.lit(chance)) / F.lit(1 - chance)


def shingles(text: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text."""
    for lo, hi, buf, offsets in tb.slices(text):
        start, end, row = tb.word_spans(buf, offsets)
        hashes = tb.span_hash(tb.prefix_hash(buf, tb.LOWER), start, end)
        at = np.searchsorted(row, np.arange(hi - lo + 1))
        for k in range(hi - lo):
            own = hashes[at[k] : at[k + 1]]
            yield lo + k, np.unique(tb.gram_hash(own, words if len(own) >= words else max(1, len(own))))


def _pack(low: np.ndarray, bits: int) -> np.ndarray:
    """Low bits of the minima in 64-bit lanes."""
    lanes = low.reshape(-1, 64 // bits)
    return np.bitwise_or.reduce(lanes << (np.arange(64 // bits, dtype=np.uint64) * np.uint64(bits)), axis=1)


def _minima(grams: np.ndarray, n: int) -> np.ndarray:
    """The least of n hashes over the set."""
    minima = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, _CELLS // n)
    for lo in range(0, len(grams), step):
        part = (grams[None, lo : lo + step] ^ _FLIP[:n, None]) * _ODD[:n, None]
        np.minimum(minima, part.min(axis=1), out=minima)
    return minima


def _low(minima: np.ndarray, bits: int) -> np.ndarray:
    return _pack(minima & np.uint64((1 << bits) - 1), bits).view(np.int64)


def _signature(grams: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and packed low bits."""
    minima = _minima(grams, max(near.minima, near.bands * near.rows))
    key = np.arange(near.bands, dtype=np.uint64)
    for column in minima[: near.bands * near.rows].reshape(near.bands, near.rows).T:
        key = tb.mix(key + column)
    return key.view(np.int64), _low(minima[: near.minima], near.bits)


def signatures(docs: DataFrame, near: Near) -> DataFrame:
    """doc_id, n_shingles, fingerprint of the set, band keys, packed signature (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n_shingles": [], "print": [], "bands": [], "packed": []}
            for _, grams in shingles(batch.column("text"), near.words):
                keys, packed = _signature(grams, near) if len(grams) else (None, None)
                out["n_shingles"].append(len(grams))
                out["print"].append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None)
                out["bands"].append(keys)
                out["packed"].append(packed)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(out["n_shingles"], pa.int64()),
                    pa.array(out["print"], pa.binary()),
                    pa.array(out["bands"], pa.list_(pa.int64())),
                    pa.array(out["packed"], pa.list_(pa.int64())),
                ],
                names=["doc_id", *out],
            )

    schema = "doc_id long, n_shingles long, print binary, bands array<long>, packed array<long>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and the whole set of shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, held = batch.column("doc_id"), [], 0
            for row, grams in shingles(batch.column("text"), words):
                rows.append((row, grams.view(np.int64)))
                held += len(grams)
                if held > 1 << 20 or row == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array([r for r, _ in rows])), pa.array([g for _, g in rows], pa.list_(pa.int64()))],
                        names=["doc_id", "grams"],
                    )
                    rows, held = [], 0

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, grams array<long>")


def finer(sets: DataFrame, near: Near) -> DataFrame:
    """doc_id and the low bits of ``near.fine`` minima of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, out = batch.column("grams"), []
            for k in range(batch.num_rows):
                own = grams.slice(k, 1).flatten().to_numpy().view(np.uint64)
                out.append(_low(_minima(own, near.fine), near.bits))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "fine"])

    return sets.select("doc_id", "grams").mapInArrow(run, "doc_id long, fine array<long>")


def _equal_low_bits(near: Near, a: str, b: str) -> Column:
    """Number of equal minima, from the packed signatures, by bit counts."""
    lane = sum(1 << (near.bits * k) for k in range(64 // near.bits))
    lane -= (1 << 64) if lane >= 1 << 63 else 0

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        folded = d
        for k in range(1, near.bits):
            folded = folded.bitwiseOR(F.shiftrightunsigned(d, k))
        return F.bit_count(folded.bitwiseAND(F.lit(lane).cast("long"))).cast("int")

    parts = F.zip_with(a, b, differing)
    return F.lit(near.minima) - F.aggregate(parts, F.lit(0), lambda s, x: s + x)


def _confirmed(pairs: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """Pairs (a, b) with the similarity of their full sets and whether that links them."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    out = pairs.join(one, "a").join(two, "b").withColumn("both", both)
    union = F.size("ga") + F.size("gb") - F.col("both")
    return out.select(
        "a",
        "b",
        (F.col("both") / union).alias("similar"),
        (F.col("both") * 100 >= union * near.percent).alias("linked"),
    )


def _cross(members: DataFrame, near: Near, best: bool) -> DataFrame:
    """(owner, a, b, equal): pairs of one bucket but different components that may reach the threshold.

    A bucket is dealt over blocks of about ``BLOCK`` members; a task compares two blocks at a time. A pair is seen in
    its first common band only. With ``best`` a member leaves the task with its best partner there.
    """
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    fields = ("doc_id", "root", "n_shingles", "bands", "fine", "hub", "similar")
    held = dealt.groupBy("band", "key", "block").agg(
        F.first("blocks").alias("blocks"), F.collect_list(F.struct(*fields)).alias("rows")
    )
    left = held.select("band", "key", "block", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("other"), F.col("rows").alias("x"))
    right = held.select("band", "key", F.col("block").alias("other"), F.col("rows").alias("y"))
    both = left.join(right, ["band", "key", "other"]).select("band", (F.col("block") == F.col("other")).alias("same"), "x", "y")
    lane = np.uint64(sum(1 << (near.bits * k) for k in range(64 // near.bits)))
    share, least = near.percent / 100, near.least_equal(near.fine)

    def columns(rows: pa.Array) -> dict[str, np.ndarray]:
        own = {f: rows.field(f) for f in fields}
        wide = {f: own[f].flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) for f in ("bands", "fine")}
        plain = {f: own[f].fill_null(-1).to_numpy(zero_copy_only=False) for f in fields if f not in wide}
        return plain | wide

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                band, same = batch.column("band")[k].as_py(), batch.column("same")[k].as_py()
                x = columns(batch.column("x").slice(k, 1).flatten())
                y = x if same else columns(batch.column("y").slice(k, 1).flatten())
                packed = y["fine"].view(np.uint64)
                top_x, top_y = (np.full(len(z["doc_id"]), -1) for z in (x, y))
                with_x, with_y = np.zeros(len(top_x), np.int64), np.zeros(len(top_y), np.int64)
                for i in range(len(x["doc_id"])):
                    ok = y["root"] != x["root"][i]
                    if same:
                        ok[: i + 1] = False
                    small = np.minimum(y["n_shingles"], x["n_shingles"][i])
                    ok &= small >= share * np.maximum(y["n_shingles"], x["n_shingles"][i]) - 1e-9
                    # the Jaccard distance is a metric: distances to one hub bound the distance between two
                    known = (y["hub"] == x["hub"][i]) & (y["similar"] >= 0) & (x["similar"][i] >= 0)
                    ok &= ~known | (np.abs(y["similar"] - x["similar"][i]) <= 1 - share + 1e-9)
                    if band:
                        ok &= ~(y["bands"][:, :band] == x["bands"][i, :band]).any(axis=1)
                    at = np.flatnonzero(ok)
                    if not len(at):
                        continue
                    d = packed[at] ^ x["fine"].view(np.uint64)[i]
                    folded = d.copy()
                    for s in range(1, near.bits):
                        folded |= d >> np.uint64(s)
                    equal = near.fine - np.bitwise_count(folded & lane).sum(axis=1).astype(np.int64)
                    at, equal = at[equal >= least], equal[equal >= least]
                    if best and len(at):
                        k = int(equal.argmax())
                        if equal[k] > top_x[i]:
                            top_x[i], with_x[i] = equal[k], y["doc_id"][at[k]]
                        more = equal > top_y[at]
                        top_y[at[more]], with_y[at[more]] = equal[more], x["doc_id"][i]
                    elif len(at):
                        yield pairs(np.full(len(at), x["doc_id"][i]), y["doc_id"][at], equal)
                if best:
                    yield pairs(x["doc_id"][top_x >= 0], with_x[top_x >= 0], top_x[top_x >= 0])
                    yield pairs(y["doc_id"][top_y >= 0], with_y[top_y >= 0], top_y[top_y >= 0])

    def pairs(owner: np.ndarray, other: np.ndarray, equal: np.ndarray) -> pa.RecordBatch:
        columns = [owner, np.minimum(owner, other), np.maximum(owner, other), equal]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["owner", "a", "b", "equal"])

    return both.mapInArrow(run, "owner long, a long, b long, equal long")


def _joined(names: DataFrame, links: DataFrame) -> DataFrame:
    """``names`` (node, root) after more links (a, b) between nodes."""
    lifted = (
        links.join(names.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        .join(names.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        .select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    )
    tops = components(lifted, "near-components").select(F.col("node").alias("root"), F.col("root").alias("top"))
    return cut(names.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "near-names")


def near_duplicates(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept: a row for every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(signatures(docs, near), "near-signed")
    usable = signed.where("print is not null and doc_id is not null")
    firsts = cut(usable.groupBy("print").agg(F.min("doc_id").alias("first")), "near-firsts")
    nodes = (
        usable.join(firsts, (usable["print"] == firsts["print"]) & (F.col("doc_id") == F.col("first")))
        .select("doc_id", "n_shingles", "bands", "packed")
        .dropDuplicates(["doc_id"])
    )
    nodes = cut(nodes, "near-nodes")

    banded = nodes.select("doc_id", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    members = cut(banded.join(shared, ["band", "key"]), "near-members")
    company = members.groupBy("doc_id").agg(F.sum("size").alias("company"))
    rated = members.join(company, "doc_id")
    hubs = rated.groupBy("band", "key").agg(F.max_by("doc_id", F.struct("company", -F.col("doc_id"))).alias("a"))
    spokes = members.join(hubs, ["band", "key"]).where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct()

    one = nodes.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("packed").alias("pa"))
    two = nodes.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("packed").alias("pb"))
    likely = (
        spokes.join(one, "a")
        .join(two, "b")
        .where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * near.percent)
        .where(_equal_low_bits(near, "pa", "pb") >= near.least_equal(near.minima))
        .select("a", "b")
    )
    candidates = cut(members.select("doc_id").distinct(), "near-candidates")
    sets = cut(shingle_sets(docs.join(candidates, "doc_id", "left_semi"), near.words), "near-sets").dropDuplicates(
        ["doc_id"]
    )
    compared = cut(_confirmed(likely, sets, near), "near-compared")
    names = candidates.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("root"))
    names = _joined(names, compared.where("linked").select("a", "b"))

    nearest = compared.groupBy("b").agg(F.max_by(F.struct("a", "similar"), F.struct("similar", -F.col("a"))).alias("h"))
    known = nearest.select(F.col("b").alias("doc_id"), F.col("h.a").alias("hub"), F.col("h.similar").alias("similar"))
    described = nodes.drop("packed").join(finer(sets, near), "doc_id").join(known, "doc_id", "left")
    described = cut(described, "near-described")
    for rounds in range(BEST_ROUNDS + 1):
        best = rounds < BEST_ROUNDS
        rooted = members.join(names.withColumnRenamed("node", "doc_id"), "doc_id")
        apart = rooted.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
        left = rooted.join(apart.select("band", "key"), ["band", "key"], "left_semi").join(described, "doc_id")
        found = _cross(left, near, best)
        if best:
            own = found.groupBy("owner").agg(F.max_by(F.struct("a", "b"), F.struct("equal", -F.col("a"), -F.col("b"))).alias("p"))
            found = own.select("p.a", "p.b").distinct()
        found = cut(found.select("a", "b"), "near-found")
        names = _joined(names, _confirmed(found, sets, near).where("linked").select("a", "b"))
    final = nodes.select(F.col("doc_id").alias("first")).join(names.withColumnRenamed("node", "first"), "first", "left")
    final = final.select("first", F.coalesce("root", "first").alias("component_id"))
    labelled = firsts.join(final, "first").select("print", "component_id")
    out = signed.select("doc_id", "n_shingles", "print").join(labelled, "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def first_of_each(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its group, with all their columns.

    Of rows that repeat a doc_id with its text one stays.
    """
    gone = near_duplicates(docs, near).where("not kept").select(F.col("doc_id").alias("_gone"))
    left = docs.join(gone.distinct(), docs["doc_id"].cast("long") == F.col("_gone"), "left_anti")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    return left if repeated.isEmpty() else left.dropDuplicates(["doc_id", "text"])
