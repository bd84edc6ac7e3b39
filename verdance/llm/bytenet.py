"""Quality classifier: a byte-level convolutional network in NumPy.

``FILTERS`` learned filters of ``WIDTH`` bytes are slid over the whole text. Each chunk of ``CHUNK`` places keeps every
filter's largest response; the chunks' windows overlap into the next chunk, so no pattern is lost at a border. The
maximum and the mean of the chunks' responses go through one logistic unit to a probability.

It learns from labelled rows whose CRC-32 of the doc_id as text is not 0 modulo 5, from at most ``TRAIN_ROWS`` of them
(those with the smallest hash of the doc_id) and, of a training text over ``TRAIN_BYTES``, from evenly spaced chunks over
its whole length. These bounds concern learning only: every text is scored as a whole. Nothing but the text's bytes
enters a score.

Null or empty texts have no response and get the probability of the bias. A label that is null is no label; rows that
share a doc_id are scored each; without any label every score is 0.5. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdance.llm import textbytes as tb

FILTERS, WIDTH, CHUNK = 16, 6, 64
TRAIN_ROWS, TRAIN_BYTES = 4000, 8192
EPOCHS, BATCH, RATE, DECAY = 14, 24, 0.02, 1e-4
#: A score from here on predicts label 1.
THRESHOLD = 0.3
_SLICE = 1 << 17
_OFF = np.float32(-1e9)


@dataclass
class Net:
    """table[j, byte] is what a byte at place j adds to every filter; byte 0 marks places outside of a text."""

    table: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    offset: float

    @classmethod
    def fresh(cls, seed: int = 5) -> Net:
        r = np.random.default_rng(seed)
        table = r.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        table[:, 0] = 0
        table[0, 0] = _OFF
        return cls(table, np.zeros(FILTERS, np.float32), r.normal(0, 0.3, 2 * FILTERS).astype(np.float32), 0.0)

    def responses(self, laid: np.ndarray) -> np.ndarray:
        """Responses of all filters at all places, for texts laid out with pads."""
        n = len(laid) - WIDTH + 1
        out = np.take(self.table[0], laid[:n], axis=0)
        for j in range(1, WIDTH):
            out += np.take(self.table[j], laid[j : j + n], axis=0)
        return out

    def probability(self, features: np.ndarray) -> np.ndarray:
        logit = features @ self.weight.astype(np.float64) + self.offset
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        laid, first = lay_out(buf, offsets)
        top = self.responses(laid).reshape(-1, CHUNK, FILTERS).max(axis=1)
        top = np.maximum(top + self.bias, 0)
        size = np.diff(np.append(first, len(top)))
        mean = np.add.reduceat(top, first, axis=0, dtype=np.float64) / size[:, None]
        return self.probability(np.concatenate((np.maximum.reduceat(top, first, axis=0), mean), axis=1))


def lay_out(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts one behind another, each begun at a whole chunk and followed by zeros; the first chunk of each."""
    size = np.diff(offsets)
    chunks = -(-(size + WIDTH - 1) // CHUNK)
    first = np.concatenate(([0], np.cumsum(chunks)))
    laid = np.zeros(first[-1] * CHUNK + WIDTH - 1, np.uint8)
    shift = np.repeat(first[:-1] * CHUNK - offsets[:-1], size)
    laid[np.arange(len(buf)) + shift] = np.maximum(buf, 1)
    return laid, first[:-1]


def _spaced(text: bytes) -> bytes:
    if len(text) <= TRAIN_BYTES:
        return text
    at = np.linspace(0, len(text) - CHUNK, TRAIN_BYTES // CHUNK).astype(int)
    return b"".join(text[a : a + CHUNK] for a in at)


def fit(texts: list[bytes], labels: list[int]) -> Net:
    """Trains by Adam on the logistic loss; the same rows give the same network."""
    net, y = Net.fresh(), np.array(labels, np.float64)
    share = (y.sum() + 1) / (len(y) + 2)
    net.offset = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        net.weight[:] = 0
        return net
    texts = [_spaced(t) for t in texts]
    order = np.random.default_rng(11)
    params = {"table": net.table, "bias": net.bias, "weight": net.weight, "offset": np.array([net.offset])}
    params = {k: v.astype(np.float32) for k, v in params.items()}
    moments = {k: (np.zeros(v.shape), np.zeros(v.shape)) for k, v in params.items()}
    steps = 0
    total = EPOCHS * -(-len(texts) // BATCH)
    for _ in range(EPOCHS):
        shuffled = order.permutation(len(texts))
        for lo in range(0, len(texts), BATCH):
            rows = shuffled[lo : lo + BATCH]
            net = Net(params["table"], params["bias"], params["weight"], float(params["offset"][0]))
            grads = _gradients(net, [texts[r] for r in rows], y[rows])
            steps += 1
            rate = RATE * (1 - steps / (total + 1))
            for k, g in grads.items():
                g = g + DECAY * (params[k] if k in ("weight",) else 0)
                m, v = moments[k]
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                step = rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-8)
                params[k] = (params[k] - step).astype(np.float32)
            params["table"][:, 0] = 0
            params["table"][0, 0] = _OFF
    return Net(params["table"], params["bias"], params["weight"], float(params["offset"][0]))


def _gradients(net: Net, texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    laid, first = lay_out(np.frombuffer(b"".join(texts), np.uint8), offsets)
    every = net.responses(laid).reshape(-1, CHUNK, FILTERS)
    place = every.argmax(axis=1)
    raw = np.take_along_axis(every, place[:, None, :], axis=1)[:, 0] + net.bias
    top = np.maximum(raw, 0)
    size = np.diff(np.append(first, len(top)))
    owner = np.repeat(np.arange(len(texts)), size)
    peak, mean = np.maximum.reduceat(top, first, axis=0), np.add.reduceat(top, first, axis=0) / size[:, None]
    features = np.concatenate((peak, mean), axis=1)
    error = (net.probability(features) - y) / len(y)
    to_features = error[:, None] * net.weight
    # back through the mean and, at its first chunk, the peak
    is_peak = top == peak[owner]
    number = np.cumsum(is_peak, axis=0)
    start = number[first] - is_peak[first]
    is_peak &= number - start[owner] == 1
    to_top = to_features[owner, FILTERS:] / size[owner, None] + is_peak * to_features[owner, :FILTERS]
    to_top = to_top * (raw > 0)
    at = place + (np.arange(len(top)) * CHUNK)[:, None]
    table = np.empty(net.table.shape)
    filters = np.broadcast_to(np.arange(FILTERS), at.shape)
    for j in range(WIDTH):
        cell = laid[at + j].astype(np.int64) * FILTERS + filters
        table[j] = np.bincount(cell.ravel(), to_top.ravel(), 256 * FILTERS).reshape(256, FILTERS)
    return {"table": table, "bias": to_top.sum(axis=0), "weight": error @ features, "offset": np.array([error.sum()])}


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame) -> Net:
    """A network fitted to the labels of at most ``TRAIN_ROWS`` rows of ``docs``."""
    known = labels.where("quality is not null").select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality"))
    known = known.where(~held_out()).distinct()
    ids = docs.select(F.col("doc_id").cast("long"))
    chosen = ids.join(known, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(TRAIN_ROWS)
    # long training texts leave their partition as evenly spaced chunks
    text, last = F.col("text").cast("string").cast("binary"), TRAIN_BYTES // CHUNK - 1
    step = (F.octet_length(text) - CHUNK) / F.lit(last)
    parts = F.transform(
        F.sequence(F.lit(0), F.lit(last)),
        lambda k: F.substring(text, F.floor(k * step).cast("int") + 1, F.lit(CHUNK)),
    )
    spaced = F.aggregate(parts, F.lit(b""), lambda a, part: F.concat(a, part))
    short = F.when(F.octet_length(text) <= TRAIN_BYTES, text).otherwise(spaced)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(short, F.lit(b"")).alias("bytes")).join(F.broadcast(chosen), "doc_id")
    got = sorted((r["doc_id"], r["quality"], bytes(r["bytes"])) for r in rows.collect())
    if not got:
        net = Net.fresh()
        net.weight[:] = 0
        return net
    return fit([t for _, _, t in got], [min(max(q, 0), 1) for _, q, _ in got])


def probability(net: Net) -> Column:
    """The score of the column ``text``; only the text goes to Python, and only the score comes back."""

    def run(text: pa.Array) -> pa.Array:
        parts = [net.score(buf, at) for _, _, buf, at in tb.slices(text, _SLICE)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return F.arrow_udf(run, T.DoubleType())(F.col("text").cast("string"))


def scored(docs: DataFrame, net: Net, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all) with score and predicted; columns with these names give way."""
    names = [c for c in columns or docs.columns if c not in ("score", "predicted")]
    out = docs.select(*names, probability(net).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, net: Net) -> DataFrame:
    """The rows of ``docs`` that are predicted 1."""
    return docs.where(probability(net) >= THRESHOLD)
