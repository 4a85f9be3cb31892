"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its lower-cased words, their beginnings of 4 to 10 bytes and their runs of 6 bytes, hashed
into ``2 ** bits`` buckets; a bucket is present or not. The machine scores ``w0 + sum w_i + sum over pairs
<v_i, v_j>`` through a logistic link, so a pair of terms can weigh more, or less, than both alone.

Fitting takes at most ``sample_rows`` labelled rows, chosen by the hash of their id. Their buckets are counted
per label by Spark, and ``features`` of them carry weights; the others are zero. Half of these places go to the buckets
that speak most for toxicity by themselves (log likelihood ratio of at least ``least_gain``), an eighth to those that speak
most against it, and the rest to partners: buckets that tell the labels apart, either way, among the rows that hold one of
the first kind. A group mention that is as common in clean texts, or a word of quoting that makes an insult harmless,
says nothing by itself but is a partner. The model is a few arrays of fixed size. Scoring reads every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Words, materialize, slices

RUN_BYTES = 6
BEGINNING_BYTES = range(4, 11)
#: Bytes that separate terms: all of ASCII but letters and digits.
_TERMS = bytes(LOWER[b] if b > 127 or chr(b).isalnum() else 0x20 for b in range(256))


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    features: int = 2048
    sample_rows: int = 30_000
    least_gain: float = 10.0
    factors: int = 6
    steps: int = 250
    rate: float = 0.05
    decay: float = 3e-5
    threshold: float = 0.3
    seed: int = 17


@dataclass(frozen=True)
class Model:
    """``buckets`` sorted; weights of bucket ``buckets[i]`` are ``linear[i]`` and ``factors[i]``."""

    bits: int
    buckets: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, rows: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of ``n`` texts; (rows, features) are the present features, each once, by row."""
        total = self.bias + np.bincount(rows, self.linear[features], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[features, f]
            total += 0.5 * (np.bincount(rows, v, n) ** 2 - np.bincount(rows, v * v, n))
        return 1.0 / (1.0 + np.exp(-np.clip(total, -40, 40)))


def present(texts: pa.Array, bits: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of all terms, each pair once and in order; ``wanted`` marks the buckets to keep."""
    words = Words(pc.utf8_lower(texts), _TERMS)
    shift = np.uint64(64 - bits)
    found = [((words.hashes >> shift).astype(np.int64), words.starts)]
    runs, at = words.grams(RUN_BYTES)
    found.append(((runs >> shift).astype(np.int64), at))
    for size in BEGINNING_BYTES:
        begun, at = words.beginnings(size)
        found.append(((begun >> shift).astype(np.int64), at))
    keys = []
    for bucket, at in found:
        if wanted is not None:
            keep = wanted[bucket]
            bucket, at = bucket[keep], at[keep]
        text = np.searchsorted(words.offsets, at, "right") - 1
        keys.append(text << bits | bucket)
    pairs = np.unique(np.concatenate(keys))
    return pairs >> bits, pairs & ((1 << bits) - 1)


#: Bytes of text whose terms are counted at once: all of them are held, not only those that carry weights.
COUNTED_BYTES = 1_000_000
#: The row of ``_counted`` that counts the texts themselves.
TEXTS = -1


def _counted(sample: DataFrame, bits: int, holding: np.ndarray | None = None) -> DataFrame:
    """Rows of the sample with each bucket, by label, and a row ``TEXTS`` for all of them; with ``holding`` only of the
    rows that hold one of these buckets. One operator, so that a task has one Python worker."""

    def run(batches):
        total, texts = np.zeros((2, 1 << bits), np.int64), np.zeros(2, np.int64)
        wanted = None if holding is None else _wanted(holding, bits)
        for batch in batches:
            for part in slices(batch, "text", COUNTED_BYTES):
                if wanted is not None:
                    held = np.zeros(len(part), bool)
                    held[present(part.column("text"), bits, wanted)[0]] = True
                    part = part.filter(pa.array(held))
                    if not len(part):
                        continue
                label = part.column("label").to_numpy()
                rows, buckets = present(part.column("text"), bits)
                for k in (0, 1):
                    total[k] += np.bincount(buckets[label[rows] == k], minlength=1 << bits)
                    texts[k] += (label == k).sum()
        some = np.flatnonzero(total.sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, TEXTS)), *(pa.array(np.append(total[k][some], texts[k])) for k in (0, 1))],
            names=["bucket", "n0", "n1"],
        )

    parts = sample.mapInArrow(run, "bucket long, n0 long, n1 long")
    return parts.groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _telling(counts: DataFrame, limit: int, least: float, toward: tuple[int, ...]) -> np.ndarray:
    """The buckets with the largest log likelihood ratio, of those that speak for a label in ``toward``, in rising order.

    ``counts``: ``bucket, n0, n1, all0, all1``. ``least`` keeps out what a million buckets show by chance.
    """
    n0, n1, all0, all1 = (F.col(c).cast("double") for c in ("n0", "n1", "all0", "all1"))
    both, n = n0 + n1, all0 + all1

    def term(x: Column, expected: Column) -> Column:
        return F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)

    gain = sum(
        (term(x, both * size / n) + term(size - x, (n - both) * size / n) for x, size in ((n0, all0), (n1, all1))), F.lit(0.0)
    )
    speaks_for = F.when(n1 * n > both * all1, 1).otherwise(0)
    top = counts.where(speaks_for.isin(*toward)).select("bucket", gain.alias("gain")).where(F.col("gain") >= least)
    rows = top.orderBy(F.desc("gain"), "bucket").limit(limit).collect()
    return np.array(sorted(r["bucket"] for r in rows), np.int64)


def _screened(sample: DataFrame, s: Settings) -> np.ndarray:
    """The buckets that carry weights, in rising order; none where only one label is known."""

    def counts(name: str, holding: np.ndarray | None = None) -> DataFrame | None:
        rows = materialize(_counted(sample, s.bits, holding), name)
        texts = rows.where(F.col("bucket") == TEXTS).first()
        if texts is None or not texts["n0"] or not texts["n1"]:
            return None
        return rows.where(F.col("bucket") != TEXTS).withColumns({"all0": F.lit(texts["n0"]), "all1": F.lit(texts["n1"])})

    none = np.zeros(0, np.int64)
    whole = counts("counts")
    chosen = none if whole is None else _telling(whole, s.features // 2, s.least_gain, (1,))
    if not len(chosen):
        return none
    against = _telling(whole, s.features // 8, s.least_gain, (0,))
    among = counts("among", chosen)
    room = s.features - len(chosen) - len(against)
    partners = none if among is None else _telling(among, room, s.least_gain, (0, 1))
    return np.unique(np.concatenate([chosen, against, partners]))


def _wanted(buckets: np.ndarray, bits: int) -> np.ndarray:
    marks = np.zeros(1 << bits, bool)
    marks[buckets] = True
    return marks


def _features(sample: DataFrame, buckets: np.ndarray, bits: int) -> DataFrame:
    def run(batches):
        wanted = _wanted(buckets, bits)
        for batch in batches:
            for part in slices(batch, "text"):
                rows, found = present(part.column("text"), bits, wanted)
                places = np.searchsorted(rows, np.arange(len(part) + 1)).tolist()
                index = np.searchsorted(buckets, found).astype(np.int32).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("label"),
                        pa.array([index[4 * i : 4 * j] for i, j in zip(places, places[1:])], pa.binary()),
                    ],
                    names=["label", "features"],
                )

    return sample.mapInArrow(run, "label int, features binary")


def train(rows: np.ndarray, features: np.ndarray, labels: np.ndarray, size: int, s: Settings):
    """(bias, linear, factors) by full-batch Adam on the logistic loss with squared decay."""
    rng = np.random.default_rng(s.seed)
    n = len(labels)
    theta = [np.array([np.log((labels.sum() + 0.5) / (n - labels.sum() + 0.5))]), np.zeros(size)]
    theta.append(rng.normal(0, 0.01, (size, s.factors)))
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, s.steps + 1):
        bias, linear, factors = theta
        sums = np.stack([np.bincount(rows, factors[features, f], n) for f in range(s.factors)], axis=1)
        squares = np.bincount(rows, (factors[features] ** 2).sum(axis=1), n)
        margin = bias + np.bincount(rows, linear[features], n) + 0.5 * ((sums**2).sum(axis=1) - squares)
        error = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - labels) / n
        each = error[rows]
        pull = np.bincount(features, each, size)
        grad_v = np.stack([np.bincount(features, each * sums[rows, f], size) for f in range(s.factors)], axis=1)
        grads = [error.sum(keepdims=True), pull + s.decay * linear, grad_v - pull[:, None] * factors + s.decay * factors]
        for t, g, a, b in zip(theta, grads, first, second):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            t -= s.rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-9)
    return float(theta[0][0]), theta[1], theta[2]


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """A model from ``docs`` (``doc_id``, ``text``) and ``labels`` (``doc_id``, ``toxic``), both with every row
    that may be learned from. Null ids and labels other than 0 and 1 are passed over; a text with contradicting
    labels is toxic. Without labelled rows the model scores every text 0.5 at zero weights."""
    s = settings or Settings()
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(s.sample_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    picked = texts.join(F.broadcast(known), "doc_id")  # at most ``sample_rows`` narrow rows
    # One row a text: toxic if any of its rows is.
    sample = materialize(picked.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.max("label").alias("label")), "sample")
    empty = np.zeros(0)
    if sample.isEmpty():
        return Model(s.bits, empty.astype(np.int64), 0.0, empty, np.zeros((0, s.factors)))
    buckets = _screened(sample, s)
    collected = _features(sample, buckets, s.bits).collect()  # at most ``sample_rows`` rows
    present_in = [np.frombuffer(r["features"] or b"", np.int32) for r in collected]
    rows = np.repeat(np.arange(len(collected)), [len(x) for x in present_in])
    features = np.concatenate([*present_in, np.zeros(0, np.int32)]).astype(np.int64)
    target = np.array([r["label"] for r in collected], float)
    return Model(s.bits, buckets, *train(rows, features, target, len(buckets), s))


def _scored(batches, model: Model):
    """(slice, its scores) of batches with a ``text``."""
    wanted = _wanted(model.buckets, model.bits)
    for batch in batches:
        for part in slices(batch, "text"):
            found, buckets = present(part.column("text"), model.bits, wanted)
            yield part, model.scores(found, np.searchsorted(model.buckets, buckets), len(part))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score``, 0 to 1, of every row, from the whole text and nothing else.

    Null and empty texts get the score of no terms. Null ids stay null, repeated rows are scored each, other
    columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        for part, value in _scored(batches, model):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(value)], names=["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""

    def run(batches):
        for part, value in _scored(batches, model):
            yield part.filter(pa.array(value < threshold))

    return docs.mapInArrow(run, docs.schema)
