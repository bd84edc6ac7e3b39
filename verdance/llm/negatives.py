"""Hard-negative mining with exact scores from a residue-number-system matrix product.

Vectors are whole numbers, floor(256 * x). For the inner products of a block of anchors with a block of rows, both
matrices are reduced modulo several small primes and multiplied in float32, where products of such residues are exact;
Chinese remaindering joins the residues of a product to the signed whole number. There are as many primes as the
blocks' lengths call for, so scores of any size that fits 64 bits are exact.

Work is a grid of tiles: rows are dealt over shards and anchors over groups, each row goes to every group and each
anchor to every shard, and a task holds one block of either at a time. A first pass over blocks that share a label
finds each anchor's positives, a second pass selects for each positive the best rows of other labels inside its window
of scores. A tile returns at most the wanted number for each anchor or positive, and those are merged.

Rows with a null vec_id, label or vector, with no components or with a null or non-finite one take no part; vectors of
different dimension don't meet. Rows equal in vec_id, label and vector are one row; rows that share only the vec_id are
rows and anchors of their own and never meet. Ties go to the smaller vec_id. An anchor without a positive, or without a
row in a window, has no rows in the result. An empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdance.llm.common import cut

#: A row is an anchor if its id is a multiple of this.
EVERY = 100
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's score.
LOW, HIGH = 30, 90
#: Rows and anchors of a block.
ROWS, ANCHORS = 4096, 256
#: Components multiplied before residues are reduced again, so that sums stay below 2^20 and float32 is exact.
_DEPTH = 64
_BLOCK = "block long, dim int, low long, high long, ids array<bigint>, labels array<bigint>, data binary"


@cache
def primes(number: int) -> tuple[int, ...]:
    """The ``number`` largest odd primes below 2^8; their products give more than 64 bits long before they end."""
    own = [p for p in range(255, 2, -2) if all(p % d for d in range(3, isqrt(p) + 1, 2))]
    return tuple(own[:number])


def _centred(x: np.ndarray, p: int) -> np.ndarray:
    """``x`` modulo p, between -(p - 1) / 2 and (p - 1) / 2; for whole float32 numbers up to 2^20."""
    return x - np.float32(p) * np.rint(x * np.float32(1 / p))


def residues(x: np.ndarray, p: int) -> np.ndarray:
    half = p // 2
    return ((x % p + half) % p - half).astype(np.float32)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two whole-number matrices (modulo 2^64 beyond that)."""
    longest = [float(np.sqrt((m.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0))) for m in (a, b)]
    reach = 2 * longest[0] * longest[1] * (1 + 1e-9) + 3
    number, product = 1, float(primes(1)[0])
    while product < min(reach, 2.0**65):
        number += 1
        product *= primes(number)[-1]
    return _joined([_product(a, b, p) for p in primes(number)], primes(number))


def _product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """The product modulo p, centred."""
    ra, rb = residues(a, p), residues(b, p)
    total = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, a.shape[1], _DEPTH):
        total = _centred(total + ra[:, lo : lo + _DEPTH] @ rb[:, lo : lo + _DEPTH].T, p)
    return total


def _joined(parts: list[np.ndarray], by: tuple[int, ...]) -> np.ndarray:
    """Chinese remaindering in mixed radix with centred digits, which give the signed number as it is.

    A digit is what remains of its prime's residue after the earlier digits, divided by the earlier primes.
    """
    digits: list[np.ndarray] = []
    for part, p in zip(parts, by, strict=True):
        rest, weight = part, 1
        for digit, q in zip(digits, by, strict=False):
            rest = _centred(rest - digit * np.float32(_small(weight, p)), p)
            weight = weight * q % p
        digits.append(_centred(rest * np.float32(_small(pow(weight, -1, p), p)), p))
    total, weight = np.zeros(parts[0].shape, np.int64), 1
    for digit, p in zip(digits, by, strict=True):
        total += digit.astype(np.int64) * np.int64((weight + 2**63) % 2**64 - 2**63)
        weight *= p
    return total


def _small(x: int, p: int) -> int:
    return (x + p // 2) % p - p // 2


def labelled(embeddings: DataFrame, label: Column) -> DataFrame:
    """vec_id, label, v (whole components), dim of the rows that take part, without repeated rows."""
    x = F.col("embedding").cast("array<double>")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    own = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable & (F.size("embedding") > 0))
    v = F.transform(x, lambda c: F.floor(c * 256).cast("long"))
    own = own.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))
    return own.distinct().withColumn("dim", F.size("v"))


def _blocks(vectors: DataFrame, rows: int, partitions: int) -> DataFrame:
    """Blocks of at most ``rows`` vectors of one dimension, in order of labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            ends = [*(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            lo = 0
            for end in ends:
                while lo < end:
                    part = batch.slice(lo, min(rows, end - lo))
                    lo += part.num_rows
                    ids, labels = part.column("vec_id").to_numpy(), part.column("label").to_numpy()
                    data = part.column("v").flatten().to_numpy()
                    columns = [place, int(dims[lo - 1]), labels.min(), labels.max(), ids, labels, data.tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, kinds, strict=True)], names)
                    place += 1

    long, longs = pa.int64(), pa.list_(pa.int64())
    names, kinds = ["block", "dim", "low", "high", "ids", "labels", "data"], [long, pa.int32(), long, long, longs, longs, pa.binary()]
    order = ["dim", "label", "vec_id"]
    dealt = vectors.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return dealt.select("vec_id", "label", "v", "dim").mapInArrow(run, _BLOCK)


def _tiles(anchors: DataFrame, rows: DataFrame, shards: int, groups: int, meet: Column) -> DataFrame:
    """Pairs of blocks (a.*, r.*) of one dimension for which ``meet`` holds, tile by tile."""
    a = anchors.withColumn("group", F.pmod(F.xxhash64("a_block"), F.lit(groups)).cast("int"))
    a = a.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    r = rows.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int"))
    r = r.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return r.join(a, (r["shard"] == a["shard"]) & (r["group"] == a["group"]) & (r["dim"] == a["a_dim"]) & meet)


class _Best:
    """The best rows of each key so far, by descending score and rising id."""

    def __init__(self, most: int) -> None:
        self.most, self.rows = most, [np.zeros(0, np.int64) for _ in range(3)]

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        key, score, ids = (np.concatenate(c) for c in zip(self.rows, (key, score, ids), strict=True))
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        keep = np.arange(len(key)) - np.searchsorted(key, key) < self.most
        self.rows = [key[keep], score[keep], ids[keep]]


def _leading(score: np.ndarray, allowed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the allowed entries that can be among their line's best ``most``, ties included."""
    if score.shape[1] > most:
        held = np.where(allowed, score, np.iinfo(np.int64).min)
        least = np.partition(held, -most, axis=1)[:, -most]
        allowed = allowed & (score >= least[:, None])
    return np.nonzero(allowed)


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Each pair of blocks with the scores of its anchors (lines) and rows (places)."""
    for batch in batches:
        for r in batch.itertuples(index=False):
            a, b = (np.frombuffer(x, np.int64).reshape(-1, r.dim) for x in (r.a_data, r.data))
            yield r, scores(a, b)


def _kept(pairs: DataFrame, most: int, select: Callable[..., Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> DataFrame:
    """(a_block, key, score, vec_id, rank): the best ``most`` rows by key.

    ``select`` gives keys, lines and places of the scores of a pair of blocks that count.
    """
    columns = ["a_block", "key", "score", "vec_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, _Best] = {}
        for pair, score in _pairs(batches):
            best = held.setdefault(pair.a_block, _Best(most))
            for key, line, place in select(pair, score):
                best.add(key, score[line, place], pair.ids[place])
            if sum(len(b.rows[0]) for b in held.values()) > 1 << 20:
                yield from flushed(held)
        yield from flushed(held)

    def flushed(held: dict[int, _Best]) -> Iterator[pd.DataFrame]:
        for block, best in held.items():
            yield pd.DataFrame(dict(zip(columns, (block, *best.rows), strict=True)), columns=columns)
        held.clear()

    found = pairs.mapInPandas(run, "a_block long, key long, score long, vec_id long")
    best = Window.partitionBy("a_block", "key").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def mined(
    vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank for ``labelled`` rows."""
    vectors = cut(vectors, "negatives-vectors")
    total, asked = vectors.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    # both sides of the grid grow with the root of their rows, so that neither is copied often
    shards, groups = 1 + isqrt(total // ROWS), 1 + isqrt(asked // ANCHORS) // 2
    rows = cut(_blocks(vectors, ROWS, 1 + total // (4 * ROWS)), "negatives-rows")
    anchors = _blocks(vectors.where(F.col("vec_id") % every == 0), ANCHORS, 1 + asked // (4 * ANCHORS))
    anchors = cut(anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns]), "negatives-anchors")
    read = ["dim", "ids", "labels", "data", "a_block", "a_ids", "a_labels", "a_data"]

    def same(pair: tuple, score: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        alike = (pair.a_labels[:, None] == pair.labels) & (pair.a_ids[:, None] != pair.ids)
        line, place = _leading(score, alike, positives)
        yield line, line, place

    def inside(pair: tuple, score: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        other = (pair.a_labels[:, None] != pair.labels) & (pair.a_ids[:, None] != pair.ids)
        for rank in range(1, positives + 1):
            of_rank = pair.ranks == rank
            lines, own = pair.lines[of_rank], pair.bars[of_rank]
            part, least, most = score[lines], -(-own * low // 100), own * high // 100
            line, place = _leading(part, other[lines] & (part >= least[:, None]) & (part <= most[:, None]), negatives)
            yield lines[line] * (positives + 1) + rank, lines[line], place

    overlap = (F.col("a_low") <= F.col("high")) & (F.col("low") <= F.col("a_high"))
    near = _tiles(anchors, rows, shards, groups, overlap).select(*read)
    friends = cut(_kept(near, positives, same), "negatives-positives")
    # what a block's anchors ask for: line, rank and score of their positives, at most ANCHORS * positives
    windows = friends.groupBy("a_block").agg(F.collect_list(F.struct("key", "rank", "score")).alias("w"))
    windows = windows.select("a_block", F.col("w.key").alias("lines"), F.col("w.rank").alias("ranks"), F.col("w.score").alias("bars"))
    differ = (F.col("a_low") < F.col("a_high")) | (F.col("low") < F.col("high")) | (F.col("low") != F.col("a_low"))
    far = _tiles(anchors.join(windows, "a_block"), rows, shards, groups, differ).select(*read, "lines", "ranks", "bars")
    found = _kept(far, negatives, inside).select(
        "a_block",
        F.expr(f"key div {positives + 1}").alias("key"),
        F.expr(f"int(key % {positives + 1})").alias("positive_rank"),
        "rank",
        F.col("vec_id").alias("negative_id"),
        F.col("score").alias("negative_score"),
    )
    friends = friends.select(
        "a_block", "key", F.col("rank").alias("positive_rank"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    names = anchors.select("a_block", F.posexplode("a_ids").alias("key", "anchor_id"))
    out = found.join(friends, ["a_block", "key", "positive_rank"]).join(names, ["a_block", "key"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")


#: The same by all products of anchors and rows.
ORACLE = f"""
WITH usable AS (
    SELECT DISTINCT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
           [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS alike,
           CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE a.vec_id % {EVERY} = 0
), positives AS (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS positive_rank
    FROM scored WHERE alike QUALIFY positive_rank <= {POSITIVES}
)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
       CAST(p.positive_rank AS INTEGER) AS positive_rank
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.alike
    AND {LOW} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.score
QUALIFY rank <= {NEGATIVES}
"""
