"""Quality classifier: a byte-level convolutional network in numpy.

Every byte has a learned vector; learned filters slide over the whole text.
Their responses are max-pooled inside overlapping chunks, and a text's chunks
are combined, as mean and as maximum over all chunks, by a logistic unit into
one probability.  The chunks cover the whole text, however long it is; work is
done in pieces of bounded size.

The network learns by rounds of local steps: the training texts lie in parts,
each part is a Spark task that takes the round's weights through its texts once
(Adam), and the parts' weights are averaged for the next round.  A maximum
passes its gradient to one window only, so a text's training state is the eight
bytes of each filter's best window per chunk, not its responses.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chemscore.llm.common import hash_share, pylists, record_batch, shipped, small, stage, text_slices

#: Bound of the fit: labelled texts, chosen by a hash when there are more.
FIT_ROWS = 4_000
PARTS, ROUNDS, BATCH, RATE = 8, 12, 16, 0.01
SEED = 13
#: Bytes of a window, between windows, and of half a chunk (chunks overlap by half).
WIDTH, STEP, HALF = 8, 2, 256
VECTOR, FILTERS = 8, 16
#: Windows whose responses are held at once.
PIECE_HALVES = 256
THRESHOLD = 0.3
_BELOW = np.float32(-1e9)


@dataclass
class Pooled:
    """Chunks of some texts: responses per chunk, how many chunks each text has, the windows that gave them."""
    best: np.ndarray                       # chunks x filters
    counts: np.ndarray                     # per text
    windows: np.ndarray | None = field(default=None)   # chunks x filters x WIDTH bytes


class Network:
    """Weights: vector of a byte, filters, their bias, logistic unit over (mean, maximum, minimum) of the chunks, its bias."""

    NAMES = ("vectors", "filters", "bias", "unit", "offset")

    def __init__(self, weights: list[np.ndarray]):
        self.vectors, self.filters, self.bias, self.unit, self.offset = weights

    @classmethod
    def fresh(cls, seed: int = SEED) -> Network:
        r = np.random.default_rng(seed)
        f = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        return cls([f(256, VECTOR, scale=0.5), f(WIDTH * VECTOR, FILTERS, scale=(WIDTH * VECTOR) ** -0.5),
                    np.zeros(FILTERS, np.float32), f(3 * FILTERS, scale=0.1), np.zeros(1, np.float32)])

    def weights(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.NAMES]

    def pool(self, texts: list[str], with_windows: bool = False) -> Pooled:
        """Responses of all windows, max-pooled per chunk of two halves (one half, if the text has no more)."""
        raw = [t.encode() for t in texts]
        sizes = np.array([len(b) for b in raw], np.int64)
        halves = np.maximum(1, -(-sizes // HALF))
        # Zero bytes stand behind every text: one more half where its last one is full.
        room = halves + (halves * HALF - sizes < WIDTH)
        begin = np.cumsum(room) - room
        data = np.zeros(int(room.sum()) * HALF + WIDTH, np.uint8)
        for b, at in zip(raw, begin, strict=True):
            data[at * HALF:at * HALF + len(b)] = np.frombuffer(b, np.uint8)
        per = HALF // STEP
        top = np.empty((int(room.sum()), FILTERS), self.filters.dtype)
        where = np.empty(top.shape, np.int64) if with_windows else None
        used = np.full(len(top), per)                                      # windows that start inside the text
        used[begin + halves - 1] = np.maximum(1, -(-(sizes - (halves - 1) * HALF) // STEP))
        for a in range(0, len(top), PIECE_HALVES):
            b = min(a + PIECE_HALVES, len(top))
            vectors = self.vectors[data[a * HALF:b * HALF + WIDTH]]
            view = np.lib.stride_tricks.as_strided(vectors, ((b - a) * per, WIDTH * VECTOR),
                                                   (STEP * vectors.strides[0], vectors.strides[1]), writeable=False)
            out = (view @ self.filters).reshape(b - a, per, FILTERS)
            for i in np.flatnonzero(used[a:b] < per):
                out[i, used[a + i]:] = _BELOW
            top[a:b] = out.max(axis=1)
            if with_windows:
                at = (out == top[a:b, None]).argmax(axis=1)
                where[a:b] = (np.arange(a, b) * HALF)[:, None] + STEP * at
        # A chunk is two neighbouring halves of one text.
        counts = np.maximum(1, halves - 1)
        first = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        second = first + np.repeat((halves > 1).astype(np.int64), counts)
        later = top[second] > top[first]
        best = np.where(later, top[second], top[first])
        if not with_windows:
            return Pooled(best, counts)
        at = np.where(later, where[second], where[first])
        return Pooled(best, counts, data[at[..., None] + np.arange(WIDTH)])

    def combine(self, pooled: Pooled) -> tuple[np.ndarray, ...]:
        """(responses after the rectifier, their mean, maximum and minimum per text, logits)."""
        on = np.maximum(pooled.best + self.bias, 0)
        starts = np.cumsum(pooled.counts) - pooled.counts
        mean = np.add.reduceat(on, starts, axis=0) / pooled.counts[:, None]
        most, least = np.maximum.reduceat(on, starts, axis=0), np.minimum.reduceat(on, starts, axis=0)
        return on, mean, most, least, np.hstack((mean, most, least)) @ self.unit + self.offset[0]

    def scores(self, texts: list[str]) -> np.ndarray:
        return _logistic(self.combine(self.pool(texts))[-1].astype(np.float64))

    def gradient(self, texts: list[str], labels: np.ndarray) -> list[np.ndarray]:
        """Gradient of the mean cross entropy."""
        pooled = self.pool(texts, with_windows=True)
        on, mean, most, least, logits = self.combine(pooled)
        d = ((_logistic(logits) - labels) / len(texts)).astype(np.float32)
        unit = d @ np.hstack((mean, most, least))
        text = np.repeat(np.arange(len(texts)), pooled.counts)
        to_mean, to_most, to_least = np.split(self.unit, 3)
        back = (d / pooled.counts)[text][:, None] * to_mean
        starts = np.cumsum(pooled.counts) - pooled.counts
        for held, weight in ((most, to_most), (least, to_least)):          # to the first chunk that holds the value
            equal = on == held[text]
            for s, n, slope in zip(starts, pooled.counts, d, strict=True):
                back[s + equal[s:s + n].argmax(axis=0), np.arange(FILTERS)] += slope * weight
        back *= on > 0
        x = self.vectors[pooled.windows].reshape(*on.shape, WIDTH * VECTOR)
        filters = (x * back[..., None]).sum(axis=0).T
        to = (back[..., None] * self.filters.T[None]).reshape(-1, VECTOR)
        held = pooled.windows.reshape(-1)
        vectors = np.stack([np.bincount(held, to[:, i], 256) for i in range(VECTOR)], axis=1).astype(np.float32)
        return [vectors, filters, back.sum(axis=0), unit, np.array([d.sum()], np.float32)]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train_part(weights: list[np.ndarray], texts: list[str], labels: np.ndarray, seed: int) -> list[np.ndarray]:
    """One pass of Adam over a part's texts in batches."""
    net = Network([w.copy() for w in weights])
    first = [np.zeros_like(w) for w in weights]
    second = [np.zeros_like(w) for w in weights]
    order = np.random.default_rng(seed).permutation(len(texts))
    for t, i in enumerate(range(0, len(order), BATCH), 1):
        pick = order[i:i + BATCH]
        for w, g, m, v in zip(net.weights(), net.gradient([texts[j] for j in pick], labels[pick]), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-6)
    return net.weights()


@dataclass
class Model:
    """The network, or (with labels of one kind or none) a constant score."""
    weights: list[np.ndarray] | None
    constant: float = 0.5

    def scorer(self):
        if self.weights is None:
            return lambda texts: np.full(len(texts), self.constant)
        return Network(self.weights).scores


def held_out(doc_id: int | None, folds: int = 5) -> bool:
    return zlib.crc32(str(doc_id).encode()) % folds == 0


def training_texts(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, folds: int = 5) -> DataFrame:
    """(key, text, quality, part): labelled distinct texts outside the held-out
    fold; about ``fit_rows`` of them, by a hash of the text, when there are more.
    A text with both labels counts as 1.  Only keys are shuffled for the choice."""
    labels = (labels.select("doc_id", "quality").where("doc_id is not null and quality in (0, 1)")
              .groupBy("doc_id").agg(F.max("quality").alias("quality"))
              .where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) != 0))
    labels = stage(labels, "quality-labels")
    docs = docs.select(F.col("doc_id"), "text").where("text is not null")
    key = F.xxhash64("text")
    keys = stage(docs.select("doc_id", key.alias("key")).join(small(labels), "doc_id").groupBy("key")
                 .agg(F.min("doc_id").alias("teacher"), F.max("quality").alias("quality")), "quality-keys")
    n = keys.count()
    keys = stage(keys.where(hash_share(F.xxhash64("key"), fit_rows / n)) if n > fit_rows else keys, "quality-chosen")
    texts = docs.join(small(keys), (F.col("doc_id") == F.col("teacher")) & (key == F.col("key")))
    return stage(texts.groupBy("key").agg(F.first("text").alias("text"), F.first("quality").alias("quality"))
                 .withColumn("part", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(PARTS)).cast("int")), "quality-texts")


def _round(texts: DataFrame, weights: list[np.ndarray], turn: int) -> list:
    """Each part's weights after one pass over its texts."""
    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        new = train_part(weights, list(pdf["text"]), pdf["quality"].to_numpy(np.float32), seed=turn)
        return pd.DataFrame({"n": [len(pdf)], "weights": [np.concatenate([w.reshape(-1) for w in new]).astype(np.float64)]})

    return texts.groupBy("part").applyInPandas(train, "n long, weights array<double>").collect()   # PARTS rows


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS, folds: int = 5) -> Model:
    """Learn from labelled rows outside the held-out fold (``training_texts``)."""
    texts = training_texts(shipped(docs), labels, fit_rows, folds)
    seen = {r.quality: r["count"] for r in texts.groupBy("quality").count().collect()}
    if len(seen) < 2:
        return Model(None, (seen.get(1, 0) + 1) / (sum(seen.values()) + 2))
    net = Network.fresh()
    # The logistic unit starts at the labels' share.
    net.offset[0] = np.log(seen[1] / seen[0])
    for turn in range(rounds):
        weights = net.weights()
        out = _round(texts, weights, turn)
        total = sum(r.n for r in out)
        flat = sum(np.array(r.weights) * (r.n / total) for r in sorted(out, key=lambda r: (r.n, r.weights[0])))
        cuts = np.cumsum([w.size for w in weights])[:-1]
        net = Network([p.reshape(w.shape).astype(np.float32) for p, w in zip(np.split(flat, cuts), weights, strict=True)])
    return Model(net.weights())


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better quality) and predicted
    (score >= threshold) of every row.

    Null and empty texts are one window of zero bytes.  Repeated rows and null
    ids stay (a null id counts as the text 'None' for held_out); other columns
    are ignored; an empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()),
                        ("predicted", pa.int32())])

    def run(batches):
        scorer = model.scorer()
        for batch in batches:
            ids, texts = pylists(batch, "doc_id", "text")
            for start, part in text_slices(texts):
                keys, s = ids[start:start + len(part)], scorer(part)
                yield record_batch(schema, (keys, [held_out(k, folds) for k in keys], s, [int(x >= threshold) for x in s]))

    return shipped(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")
