"""Language identification: a bidirectional gated recurrent network over bytes, in NumPy.

One network reads a text's bytes forwards, one backwards, ``UNITS`` gated units each. The two states at a byte give
the probabilities of all languages there, so every position of a text has a label; a document's probabilities are the
means over its positions. The network reads windows of ``CORE`` bytes, many at a time, and either direction warms up on
the ``CONTEXT`` bytes before its first labelled one, so each byte of a text of any length is labelled once, in bounded
memory. It learns by backpropagation through time.

It learns from rows with a text, a lang and a doc_id whose CRC-32 as text is not 2 modulo 4: from ``PIECES`` evenly
spaced pieces of ``PIECE`` bytes each of at most ``TRAIN_ROWS`` rows, the same number for every language (those with
the smallest hash of the doc_id), and the ``LANGUAGES`` commonest languages. These bounds concern learning only.
Nothing but a text's bytes enters a prediction.

A text that is null or has no letter is ``und`` with score 0; so is every text if there is nothing to learn from. Rows
that share a doc_id, or have none, are predicted each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdance.llm import textbytes as tb

UNITS, CORE, CONTEXT = 8, 256, 24
TRAIN_ROWS, LANGUAGES, PIECES, PIECE = 1200, 500, 2, 96
EPOCHS, BATCH, RATE = 3, 48, 0.03
UNKNOWN = "und"
#: What the network sees of a byte: A to Z as a to z, and never 0.
SEEN = np.maximum(tb.LOWER, 1)
#: Bytes and windows handled at once.
_SLICE, _WINDOWS = 1 << 18, 1280


def _squash(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place: the network's bounded function, cheaper than an exponential."""
    np.abs(x, out=spare)
    spare += 1
    return np.divide(x, spare, out=x)


@dataclass
class Net:
    """First axis: forwards, backwards; second axis of ``bytes`` and ``turn``: update gate, reset gate, candidate.

    Gates are (1 + squash) / 2. Byte 0 stands for what is outside of a text and adds nothing to the candidate, so a state
    of zeros stays one until the text begins.
    """

    languages: list[str]
    bytes: np.ndarray = field(repr=False)  # 2, 3, 256, units: what a byte adds
    turn: np.ndarray = field(repr=False)  # 2, 3, units, units: what the state adds
    out: np.ndarray = field(repr=False)  # 2 * units, languages
    bias: np.ndarray = field(repr=False)

    @classmethod
    def fresh(cls, languages: list[str], units: int = UNITS, seed: int = 3) -> Net:
        r = np.random.default_rng(seed)
        draw = lambda scale, *shape: r.normal(0, scale, shape).astype(np.float32)
        n = len(languages)
        net = cls(languages, draw(0.5, 2, 3, 256, units), draw(0.5 / units**0.5, 2, 3, units, units), draw(0.3, 2 * units, n), draw(0, n))
        net.bytes[:, 2, 0] = 0
        return net

    def parts(self) -> dict[str, np.ndarray]:
        return {k: getattr(self, k) for k in ("bytes", "turn", "out", "bias")}

    def states(self, read: np.ndarray, skip: int, saved: list | None = None) -> np.ndarray:
        """States (step, direction, window, unit) behind ``skip`` steps; ``read``: step, direction, window."""
        steps, _, windows = read.shape
        units = self.turn.shape[-1]
        kind = self.turn.dtype
        h = np.zeros((2, windows, units), kind)
        every = np.empty((steps - skip, 2, windows, units), kind)
        x, spare = np.empty((2, 3, windows, units), kind), np.empty((2, 2, windows, units), kind)
        pulled = np.empty((2, 3, windows, units), kind)
        for t in range(steps):
            for way in range(2):
                for gate in range(3):
                    np.take(self.bytes[way, gate], read[t, way], axis=0, out=x[way, gate], mode="clip")
                    np.matmul(h[way], self.turn[way, gate], out=pulled[way, gate])
            gates, new = x[:, :2], x[:, 2]
            gates += pulled[:, :2]
            _squash(gates, spare)
            gates += 1
            gates *= 0.5
            new += np.multiply(gates[:, 1], pulled[:, 2], out=spare[:, 0])
            _squash(new, spare[:, 0])
            if saved is not None:
                saved.append((h.copy(), gates.copy(), new.copy(), pulled[:, 2].copy()))
            h -= new
            h *= gates[:, 0]
            h += new
            if t >= skip:
                every[t - skip] = h
        return every

    def shares(self, states: np.ndarray) -> np.ndarray:
        """Probabilities (place, window, language) from the states, the backward ones turned round."""
        units = self.turn.shape[-1]
        logits = states[:, 0] @ self.out[:units] + states[::-1, 1] @ self.out[units:] + self.bias
        logits -= logits.max(axis=-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=-1, keepdims=True)
        return logits

    def labelled(self, buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text of each window, place in it of the window's first byte, probabilities) for texts one behind another.

        Places behind a text's end have probabilities too; the caller leaves them out.
        """
        size = np.diff(offsets)
        many = -(-size // CORE)
        text = np.repeat(np.arange(len(size)), many)
        place = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * CORE
        for part in np.array_split(np.arange(len(text)), -(-len(text) // _WINDOWS)) if len(text) else ():
            own, at = text[part], place[part]
            start, end = offsets[own], offsets[own + 1]
            forward = (start + at)[None] + np.arange(-CONTEXT, CORE)[:, None]
            backward = (start + at)[None] + np.arange(CORE + CONTEXT - 1, -1, -1)[:, None]
            read = np.empty((CORE + CONTEXT, 2, len(own)), np.uint8)
            for d, where in enumerate((forward, backward)):
                inside = (where >= start) & (where < end)
                read[:, d] = np.where(inside, SEEN[buf[np.clip(where, 0, max(0, len(buf) - 1))]], 0)
            yield own, at, self.shares(self.states(read, CONTEXT))

    def pooled(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities of each text: the means over its bytes (0 for an empty one)."""
        size = np.diff(offsets)
        total = np.zeros((len(size), len(self.languages)))
        for own, at, shares in self.labelled(buf, offsets):
            inside = np.arange(CORE)[:, None] < (size[own] - at)[None]
            np.add.at(total, own, np.where(inside[..., None], shares, 0).sum(axis=0, dtype=np.float64))
        return total / np.maximum(size, 1)[:, None]


def gradients(net: Net, pieces: np.ndarray, lengths: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss of all positions and its gradients, through time; ``pieces``: place, window, padded with zeros."""
    steps, windows = pieces.shape
    units = net.turn.shape[-1]
    saved: list = []
    read = np.stack((pieces, pieces[::-1]), axis=1)
    states = net.states(read, 0, saved)
    shares = net.shares(states)
    counts = (np.arange(steps)[:, None] < lengths).astype(np.float32)
    counts /= max(1.0, counts.sum())
    right = np.take_along_axis(shares, np.broadcast_to(target[None, :, None], (steps, windows, 1)), axis=2)[..., 0]
    loss = float(-(np.log(np.maximum(right, 1e-30)) * counts).sum())
    error = shares * counts[..., None]
    error[:, np.arange(windows), target] -= counts
    both = np.concatenate((states[:, 0], states[::-1, 1]), axis=2)
    grads = {k: np.zeros_like(v) for k, v in net.parts().items()}
    grads["out"] = both.reshape(-1, 2 * units).T @ error.reshape(-1, error.shape[2])
    grads["bias"] = error.sum(axis=(0, 1))
    back = error @ net.out.T
    to_state = np.stack((back[..., :units], back[::-1, :, units:]), axis=1)
    carried = np.zeros((2, windows, units), states.dtype)
    into = np.empty((steps, 2, 3, windows, units), states.dtype)
    for t in range(steps - 1, -1, -1):
        h, gates, new, pulled = saved[t]
        update, reset = gates[:, 0], gates[:, 1]
        d = to_state[t] + carried
        # the slope of the bounded function is (1 - |value|)^2
        d_new = d * (1 - update) * (1 - np.abs(new)) ** 2
        into[t, :, 0] = d * (h - new) * (1 - np.abs(2 * update - 1)) ** 2 / 2
        into[t, :, 1] = d_new * pulled * (1 - np.abs(2 * reset - 1)) ** 2 / 2
        into[t, :, 2] = d_new
        pulls = into[t].copy()
        pulls[:, 2] *= reset
        grads["turn"] += np.matmul(h[:, None].swapaxes(2, 3), pulls)
        carried = d * update + np.matmul(pulls, net.turn.swapaxes(2, 3)).sum(axis=1)
    for way in range(2):
        seen = read[:, way].ravel()
        order = np.argsort(seen, kind="stable")
        first = np.flatnonzero(np.diff(seen[order], prepend=-1))
        for gate in range(3):
            rows = into[:, way, gate].reshape(-1, units)[order]
            grads["bytes"][way, gate, seen[order][first]] = np.add.reduceat(rows, first, axis=0)
    grads["bytes"][:, 2, 0] = 0
    return loss, grads


def fit(texts: list[list[bytes]], labels: list[str]) -> Net:
    """Trains by Adam on the pieces of labelled texts; the same rows give the same network."""
    languages = sorted(set(labels))
    net = Net.fresh(languages)
    pieces = [(p, languages.index(la)) for own, la in zip(texts, labels, strict=True) for p in own if p]
    r = np.random.default_rng(17)
    parts = net.parts()
    mean, square = ({k: np.zeros(v.shape, np.float32) for k, v in parts.items()} for _ in range(2))
    step, total = 0, EPOCHS * -(-len(pieces) // BATCH)
    for _ in range(EPOCHS):
        shuffled = r.permutation(len(pieces))
        for lo in range(0, len(pieces), BATCH):
            own = [pieces[k] for k in shuffled[lo : lo + BATCH]]
            lengths = np.array([len(p) for p, _ in own])
            laid = np.zeros((lengths.max(), len(own)), np.uint8)
            for k, (p, _) in enumerate(own):
                laid[: len(p), k] = SEEN[np.frombuffer(p, np.uint8)]
            _, grads = gradients(net, laid, lengths, np.array([la for _, la in own]))
            scale = min(1.0, 1.0 / (1e-12 + float(np.sqrt(sum((g * g).sum() for g in grads.values())))))
            step += 1
            rate = RATE * (1 - (step - 1) / total)
            for k, g in grads.items():
                mean[k] += 0.1 * (g * scale - mean[k])
                square[k] += 0.01 * ((g * scale) ** 2 - square[k])
                parts[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return net


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter() -> Column:
    return F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))


def trained(docs: DataFrame) -> Net:
    """A network fitted to a bounded sample of the rows it may learn from."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & has_letter())
    known = known.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    common = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES).collect()
    if not common:
        return Net.fresh([])
    each = max(1, TRAIN_ROWS // len(common))
    # a share of each language that holds enough rows, and no more than a few times as many
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 2 * (each + 8) / r["n"])) for r in common], "lang string, share double")
    key = F.xxhash64(F.col("doc_id"))
    dealt = F.pmod(key, F.lit(1 << 30)) / float(1 << 30)
    text = F.col("text").cast("string").cast("binary")
    step = F.greatest((F.octet_length(text) - PIECE) / max(1, PIECES - 1), F.lit(float(PIECE)))
    pieces = F.array(*[F.substring(text, F.floor(k * step).cast("int") + 1, F.lit(PIECE)) for k in range(PIECES)])
    chosen = known.join(F.broadcast(share), "lang").where(dealt < F.col("share")).select("lang", key.alias("key"), "doc_id", pieces.alias("pieces"))
    got = chosen.orderBy("key", "doc_id", "lang", "pieces").limit(4 * (TRAIN_ROWS + 8 * len(common))).collect()
    texts, labels, taken = [], [], dict.fromkeys((r["lang"] for r in common), 0)
    for r in got:
        if taken[r["lang"]] < each:
            taken[r["lang"]] += 1
            texts.append([bytes(p) for p in r["pieces"]])
            labels.append(r["lang"])
    return fit(texts, labels)


def predicted(docs: DataFrame, net: Net) -> DataFrame:
    """``docs`` with lang_pred and score, and held_out; columns with these names give way."""

    def run(text: pa.Array) -> pa.Array:
        parts = [net.pooled(buf, at) for _, _, buf, at in tb.slices(text, _SLICE)]
        shares = np.concatenate(parts) if parts else np.zeros((0, len(net.languages)))
        best = shares.argmax(axis=1)
        names = pa.array(net.languages, pa.string()).take(pa.array(best))
        return pa.StructArray.from_arrays([names, pa.array(shares[np.arange(len(best)), best])], names=["lang", "score"])

    names = [c for c in docs.columns if c not in ("lang_pred", "score", "held_out")]
    if not net.languages:
        return docs.select(*names, held_out().alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    answer = F.arrow_udf(run, kind)(F.when(has_letter(), F.col("text").cast("string")))
    out = docs.select(*names, held_out().alias("held_out"), has_letter().alias("_known"), answer.alias("_found"))
    lang = F.when(F.col("_known"), F.col("_found.lang")).otherwise(UNKNOWN)
    score = F.when(F.col("_known"), F.least(F.col("_found.score"), F.lit(1.0))).otherwise(0.0)
    return out.select(*names, "held_out", lang.alias("lang_pred"), score.alias("score"))


def spans(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id and spans: stretches of bytes (start, length) whose positions have the same label (lang)."""
    kind = "array<struct<start:bigint,length:bigint,lang:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, at in tb.slices(batch.column("text"), _SLICE):
                label = np.zeros(len(buf), np.int64)
                for own, place, shares in net.labelled(buf, at):
                    where = (at[own] + place)[None] + np.arange(CORE)[:, None]
                    inside = where < at[own + 1]
                    label[where[inside]] = shares.argmax(axis=2)[inside]
                text = np.repeat(np.arange(hi - lo), np.diff(at))
                first = np.flatnonzero((np.diff(label, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
                bounds = np.searchsorted(text[first], np.arange(hi - lo + 1))
                length = np.diff(np.append(first, len(buf)))
                names = pa.array(net.languages, pa.string()).take(pa.array(label[first]))
                rows = pa.StructArray.from_arrays([pa.array(first - at[text[first]]), pa.array(length), names], names=["start", "length", "lang"])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), lists], names=["doc_id", "spans"])

    ids = F.col("doc_id").cast("long").alias("doc_id")
    if not net.languages:
        return docs.select(ids, F.array().cast(kind).alias("spans"))
    text = F.when(has_letter(), F.col("text").cast("string")).alias("text")
    return docs.select(ids, text).mapInArrow(run, f"doc_id long, spans {kind}")
