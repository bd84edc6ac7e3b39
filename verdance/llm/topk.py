"""Exact top-k by inner product: vectors in order of length, pruned by Cauchy-Schwarz bounds on rotated partial sums.

Vectors are whole numbers, floor(256 * x). A rotation by the singular vectors of all rows puts most of any inner
product into the first coordinates; what the other coordinates can add at most is the product of the two residual
lengths. Vectors are sorted by descending length and cut into blocks, queries into blocks as well.

* The longest block gives each query a first lower bound on its k-th best score.
* A pair of blocks is only made if the longest vector of the one could still reach a bound of the other.
* In a pair of blocks vectors go by descending length: first the product of lengths, then partial sums with residual
  bounds over a growing number of coordinates decide who is scored at all. Scores are exact whole numbers, bounds are
  rounded outwards; the bounds rise on the way.
* Each pair returns at most k rows a query, and those are merged.

A vector that is null, has no components, or holds a null or non-finite component, takes no part. Vectors of different dimension don't
meet. Rows with the same vec_id and vector are one row; a query never meets rows of its own vec_id; ties go to the
smaller vec_id. Rows with a null vec_id take no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdance.llm.common import cut

K = 5
#: A row is a query if its id is a multiple of this.
EVERY = 50
VECTORS, QUERIES, STEP = 4096, 512, 512
_BLOCK = "block long, size long, longest double, ids binary, data binary"


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (whole components), dim, square (squared length)."""
    x = F.col("embedding").cast("array<double>")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    known = embeddings.where(F.col("vec_id").isNotNull() & usable & (F.size("embedding") > 0))
    v = F.transform(x, lambda c: F.floor(c * 256).cast("long"))
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return (
        known.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
        .distinct()
        .select("vec_id", "v", F.size("v").alias("dim"), square.alias("square"))
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Columns: singular vectors of the rows, largest first; from one dim x dim sum over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column("v"), dim).astype(np.float64)
            total += x.T @ x
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(a.ravel()) for a in (i, j, total)], names=["i", "j", "s"])

    cells = vectors.select("v").mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    total = np.zeros((dim, dim))
    for r in cells.collect():  # dim * dim rows
        total[r["i"], r["j"]] = r["s"]
    scale = np.abs(total).max() or 1.0
    return np.linalg.eigh(total / scale)[1][:, ::-1]


def _blocks(vectors: DataFrame, dim: int, rows: int) -> DataFrame:
    """Blocks of at most ``rows`` vectors in the order of the partitions; block numbers rise in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                ids, v = part.column("vec_id").to_numpy(), _matrix(part.column("v"), dim)
                longest = float(np.sqrt(part.column("square").to_numpy().max()))
                columns = [[place], [len(ids)], [longest], [ids.tobytes()], [v.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "size", "longest", "ids", "data"])
                place += 1

    return vectors.select("vec_id", "v", "square").mapInArrow(run, _BLOCK)


class _Best:
    """The k best of each query so far; ties go to the smaller id."""

    def __init__(self, k: int, bound: np.ndarray) -> None:
        self.k, self.bound = k, bound.copy()
        self.q, self.id, self.s = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        q, ids, score = np.concatenate((self.q, q)), np.concatenate((self.id, ids)), np.concatenate((self.s, score))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        first = np.searchsorted(q, q)
        rank = np.arange(len(q)) - first
        keep = rank < self.k
        full = rank == self.k - 1
        self.bound[q[full]] = np.maximum(self.bound[q[full]], score[full])
        self.q, self.id, self.s = q[keep], ids[keep], score[keep]


def _search(qid: np.ndarray, q: np.ndarray, bound: np.ndarray, vid: np.ndarray, v: np.ndarray, turn: np.ndarray, k: int) -> _Best:
    """The best of one block of vectors, by descending length, for one block of queries with lower bounds."""
    dim = q.shape[1]
    best = _Best(k, bound)
    qr, vr = q @ turn, v @ turn
    q_len, v_len = np.sqrt((qr**2).sum(axis=1)), np.sqrt((vr**2).sum(axis=1))
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, dim) < 2**53
    stages = sorted({max(1, dim // 8), max(1, dim // 3)}) if dim > 1 else []
    for lo in range(0, len(v), STEP):
        part = slice(lo, lo + STEP)
        slack = 1e-9 * np.outer(q_len, v_len[part]) + 1e-6
        alive = np.outer(q_len, v_len[part]) + slack >= best.bound[:, None]
        at_q = np.flatnonzero(alive.any(axis=1))
        if not len(at_q):
            continue
        alive, slack = alive[at_q], slack[at_q]
        alive &= qid[at_q, None] != vid[None, part]
        done, sums = 0, np.zeros(alive.shape)
        for upto in stages:
            sums += qr[at_q, done:upto] @ vr[part, done:upto].T
            rest = np.outer(np.sqrt((qr[at_q, upto:] ** 2).sum(axis=1)), np.sqrt((vr[part, upto:] ** 2).sum(axis=1)))
            alive &= sums + rest + slack >= best.bound[at_q, None]
            done = upto
        a, b = np.nonzero(alive)
        if not len(a):
            continue
        if not exact:
            score = (q[at_q[a]].astype(np.int64) * v[part][b].astype(np.int64)).sum(axis=1)
        elif len(a) > alive.size // 16:
            score = (q[at_q] @ v[part].T)[a, b].astype(np.int64)
        else:
            score = np.einsum("ij,ij->i", q[at_q[a]], v[part][b]).astype(np.int64)
        good = score >= best.bound[at_q[a]]
        best.add(at_q[a[good]], vid[part][b[good]], score[good])
    return best


def _scored(pairs: DataFrame, turn: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score): at most k a query for every pair of blocks (ids, data, q_ids, q_data, bounds)."""
    dim = len(turn)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                qid, vid = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64)
                q = np.frombuffer(r.q_data, np.int64).reshape(-1, dim).astype(np.float64)
                v = np.frombuffer(r.data, np.int64).reshape(-1, dim).astype(np.float64)
                bound = np.frombuffer(r.bounds, np.float64) if r.bounds is not None else np.full(len(qid), -np.inf)
                best = _search(qid, q, bound, vid, v, turn, k)
                yield pd.DataFrame({"query_id": qid[best.q], "vec_id": best.id, "score": best.s})

    return pairs.select("ids", "data", "q_ids", "q_data", "bounds").mapInPandas(run, "query_id long, vec_id long, score long")


def _merged(rows: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return rows.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _of_dimension(vectors: DataFrame, dim: int, every: int, k: int) -> DataFrame:
    own = vectors.where(F.col("dim") == dim)
    turn = rotation(own, dim)
    asked = own.where(F.col("vec_id") % every == 0)
    rows, n_asked = own.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    longest_first = [F.col("square").desc(), F.col("vec_id")]
    ordered = own.repartitionByRange(-(-rows // VECTORS), *longest_first).sortWithinPartitions(*longest_first)
    blocks = cut(_blocks(ordered, dim, VECTORS), "topk-blocks")
    asked = asked.repartition(max(1, -(-n_asked // QUERIES)))
    queries = cut(_blocks(asked, dim, QUERIES), "topk-queries").select(
        F.col("block").alias("q_block"), F.col("longest").alias("q_longest"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data")
    )
    heads = blocks.agg(F.min("block").alias("block"))
    first = blocks.join(F.broadcast(heads), "block", "left_semi")  # one block, at most VECTORS rows
    by_key = lambda df: df.withColumn("_one", F.lit(1))
    opening = by_key(queries).join(F.broadcast(by_key(first)), "_one").withColumn("bounds", F.lit(None).cast("binary"))
    opened = cut(_scored(opening, turn, k), "topk-opened")
    fifth = opened.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n"))
    lows = fifth.where(F.col("n") >= k).select("query_id", "low")

    def with_bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                found = {x["query_id"]: x["low"] for x in r.lows}
                bound = np.array([found.get(i, -np.inf) for i in np.frombuffer(r.q_ids, np.int64).tolist()], np.float64)
                q = np.frombuffer(r.q_data, np.int64).reshape(len(bound), -1).astype(np.float64)
                # the length a vector needs to reach any bound of the block
                size = np.sqrt((q**2).sum(axis=1))
                need = np.where(size > 0, bound / np.where(size > 0, size, 1), np.where(bound <= 0, -np.inf, np.inf))
                rows.append((r.q_block, bound.tobytes(), float(need.min(initial=np.inf))))
            yield pd.DataFrame(rows, columns=["q_block", "bounds", "need"])

    per_block = (
        _query_ids(queries)
        .join(lows, "query_id")
        .groupBy("q_block")
        .agg(F.collect_list(F.struct("query_id", "low")).alias("lows"))  # at most QUERIES entries
    )
    none = F.array().cast("array<struct<query_id:bigint,low:bigint>>")
    bounds = (
        queries.join(per_block, "q_block", "left")
        .select("q_block", "q_ids", "q_data", F.coalesce("lows", none).alias("lows"))
        .mapInPandas(with_bounds, "q_block long, bounds binary, need double")
    )
    asking = cut(queries.join(bounds, "q_block"), "topk-asking")
    # pairs of block numbers that can matter, before any data moves; they meet by classes of length
    numbers = blocks.select("block", "longest", _class(F.col("longest")).alias("class"))
    numbers = cut(numbers.join(F.broadcast(heads), "block", "left_anti"), "topk-numbers")
    low, high = numbers.agg(F.min("class"), F.max("class")).first()
    if low is None:
        return _merged(opened, k)
    least = F.greatest(_class(F.col("need")) - 1, F.lit(low))
    reached = asking.where(least <= high).select("q_block", "need", F.explode(F.sequence(least, F.lit(high))).alias("class"))
    pairs = reached.join(numbers, "class").where(F.col("longest") * (1 + 1e-9) + 1e-6 >= F.col("need"))
    chosen = pairs.select("q_block", "block").join(blocks, "block").join(asking, "q_block")
    return _merged(opened.unionByName(_scored(chosen, turn, k)), k)


def _class(length: Column) -> Column:
    """Number of a class of lengths, four to a doubling; never falls as the length grows."""
    return F.floor(F.log2(F.least(F.greatest(length, F.lit(1e-6)), F.lit(1e300))) * 4)


def _query_ids(queries: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids in zip(batch.column("q_block").to_pylist(), batch.column("q_ids").to_pylist(), strict=True):
                own = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), pa.array(own)], names=["q_block", "query_id"])

    return queries.select("q_block", "q_ids").mapInArrow(run, "q_block long, query_id long")


def top_k(embeddings: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is a multiple of ``every``."""
    vectors = cut(whole_vectors(embeddings), "topk-vectors")
    dims = [r["dim"] for r in vectors.select("dim").distinct().orderBy("dim").collect()]
    out = None
    for dim in dims:
        found = _of_dimension(vectors, dim, every, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
