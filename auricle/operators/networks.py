"""Rectified heads: features -> hidden rectified units with dropout -> softmax.

Training is by mini-batches of the whole table: the rows are written once, dealt to batches by the hash of their key,
and a step reads one batch. Each task adds up the gradient of its rows, Spark adds the tasks' gradients (in two
levels when there are many tasks), and the driver sees one vector of the size of the network. Dropout is a hash of
row, step and unit, so a task that runs twice gives the same gradient. The driver keeps the moments of the steps
(Adam), lowers the rate when the validation loss stands still, and stops early with the best weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..sources.sinks import scratch_path
from .checks import DataContractError

#: Tasks whose gradients are added up at once.
FAN = 64
VALIDATION = -1


@dataclass(frozen=True)
class NetworkSettings:
    hidden: int = 256
    dropout: float = 0.3
    epochs: int = 50
    batches: int = 4
    learning_rate: float = 0.01
    patience: int = 5
    rate_patience: int = 2
    rate_factor: float = 0.5
    least_rate: float = 1e-5
    balanced: bool = True
    seed: int = 42

    def __post_init__(self):
        if not 0 <= self.dropout < 1 or min(self.hidden, self.epochs, self.batches) < 1:
            raise ValueError("sizes must be positive and the dropout below 1")


@dataclass
class Network:
    """``weights``: hidden weights, hidden bias, output weights, output bias. ``history``: one row per epoch."""

    weights: list[np.ndarray]
    history: list[dict] = field(default_factory=list)

    @property
    def shapes(self) -> list[tuple[int, ...]]:
        return [w.shape for w in self.weights]

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights])

    def like(self, flat: np.ndarray) -> Network:
        """The network of these shapes with other values."""
        ends = np.cumsum([int(np.prod(s)) for s in self.shapes])
        return Network([p.reshape(s) for p, s in zip(np.split(flat, ends[:-1]), self.shapes)], self.history)

    def forward(self, x: np.ndarray, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hidden sums, hidden units after dropout, probabilities); ``kept`` scales the hidden units."""
        w1, b1, w2, b2 = self.weights
        sums = x @ w1 + b1
        units = np.maximum(sums, 0)
        if kept is not None:
            units = units * kept
        out = units @ w2 + b2
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return sums, units, out / out.sum(axis=1, keepdims=True)

    def loss(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, kept: np.ndarray | None = None) -> float:
        """Weighted sum of the cross entropies."""
        p = self.forward(x, kept)[2][np.arange(len(y)), y]
        return float(-(weight * np.log(np.maximum(p, 1e-300))).sum())

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, kept: np.ndarray | None = None) -> np.ndarray:
        """Gradient of ``loss``, flat."""
        sums, units, p = self.forward(x, kept)
        out = p.copy()
        out[np.arange(len(y)), y] -= 1
        out *= weight[:, None]
        back = (out @ self.weights[2].T) * (sums > 0)
        if kept is not None:
            back = back * kept
        return np.concatenate([(x.T @ back).ravel(), back.sum(axis=0), (units.T @ out).ravel(), out.sum(axis=0)])


def initial(width: int, hidden: int, classes: int, seed: int) -> Network:
    """Uniform weights within sqrt(6 / (inputs + outputs)), zero biases."""
    r = np.random.default_rng(seed)

    def layer(a: int, b: int) -> np.ndarray:
        far = np.sqrt(6 / (a + b))
        return r.uniform(-far, far, (a, b))

    return Network([layer(width, hidden), np.zeros(hidden), layer(hidden, classes), np.zeros(classes)])


def dropout_mask(keys: np.ndarray, units: int, step: int, rate: float, seed: int) -> np.ndarray | None:
    """0 for a dropped unit, else 1 / (1 - rate): a function of row key, unit, step and seed alone."""
    if not rate:
        return None
    x = keys.astype(np.int64).view(np.uint64)[:, None] ^ (np.arange(units, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = x + np.uint64((step * 0xD1B54A32D192ED03 + seed * 0x8CB92BA72F3D8DD7) % 2**64)
    # A 64-bit finalizer (fixed values): every input bit reaches every output bit.
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x = x ^ (x >> np.uint64(31))
    return (x >= np.uint64(int(rate * 2.0**64))) / (1 - rate)


def _stacked(column, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), width)


def _step(rows: DataFrame, tasks: int, net: Network, width: int, batch: int, step: int, s: NetworkSettings) -> dict:
    """Sums over the rows of a batch and of the validation set: gradient, losses, rows, right answers."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros(len(net.flat())), np.zeros(5)
        for b in batches:
            x, y = _stacked(b.column("_x"), width), b.column("_y").to_numpy()
            weight, keys, part = (b.column(c).to_numpy() for c in ("_w", "_key", "_batch"))
            mine, held = part != VALIDATION, part == VALIDATION
            if mine.any():
                kept = dropout_mask(keys[mine], s.hidden, step, s.dropout, s.seed)
                total += net.gradient(x[mine], y[mine], weight[mine], kept)
                sums[:2] += net.loss(x[mine], y[mine], weight[mine], kept), mine.sum()
            if held.any():
                right = (net.forward(x[held])[2].argmax(axis=1) == y[held]).sum()
                sums[2:] += net.loss(x[held], y[held], np.ones(held.sum())), held.sum(), right
        values = [np.concatenate([total, sums]).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.float64()))], names=["sums"])

    used = rows.filter(F.col("_batch").isin(batch, VALIDATION))
    parts = used.mapInArrow(partial, "sums array<double>").select(
        array_to_vector("sums").alias("sums"), F.spark_partition_id().alias("part")
    )
    added = Summarizer.metrics("sum")
    if tasks > FAN:
        level = F.pmod("part", F.lit(int(np.ceil(np.sqrt(tasks)))))
        parts = parts.groupBy(level.alias("g")).agg(added.summary(F.col("sums")).alias("s")).select(F.col("s.sum").alias("sums"))
    whole = parts.agg(added.summary(F.col("sums")).alias("s")).select(vector_to_array("s.sum").alias("v")).first()["v"]
    whole = np.array(whole)
    loss, n, held_loss, held_n, right = whole[-5:]
    return {"gradient": whole[:-5], "loss": loss, "n": n, "held_loss": held_loss, "held_n": held_n, "right": right}


def fit_network(
    rows: DataFrame, features: str, label: str, key: str, n_classes: int, settings: NetworkSettings | None = None
) -> Network:
    """Train on the rows of split ``train``, stop by those of split ``val``; ``rows`` carries split.

    The loss is the cross entropy, weighted by ``N / (classes * n_class)`` if ``balanced``. Rows without features or
    with a label that is no class are left out. A class without training rows, no validation rows, or features of
    different lengths are an error.
    """
    s = settings or NetworkSettings()
    sound = rows.filter(F.col(features).isNotNull() & F.col(label).between(0, n_classes - 1) & F.col("split").isin("train", "val"))
    shape = sound.agg(
        F.min(F.size(features)).alias("least"),
        F.max(F.size(features)).alias("width"),
        F.count_if(F.col("split") == "val").alias("held"),
        *[F.count_if((F.col("split") == "train") & (F.col(label) == c)).alias(f"n{c}") for c in range(n_classes)],
    ).first()
    counts = np.array([shape[f"n{c}"] for c in range(n_classes)])
    if not counts.all():
        raise DataContractError(f"no training rows for classes {np.flatnonzero(counts == 0).tolist()}")
    if not shape["held"] or shape["least"] != shape["width"]:
        raise DataContractError("a network needs validation rows and features of one length")
    weight = counts.sum() / (n_classes * counts) if s.balanced else np.ones(n_classes)
    hashed = F.xxhash64(F.lit(s.seed), F.col(key).cast("string"))
    batch = F.when(F.col("split") == "val", VALIDATION).otherwise(F.pmod(hashed, F.lit(s.batches)).cast("int"))
    table = sound.select(
        v.doubles(features).alias("_x"),
        F.col(label).cast("int").alias("_y"),
        F.get(F.array(*[F.lit(float(w)) for w in weight]), F.col(label).cast("int")).alias("_w"),
        hashed.alias("_key"),
        batch.alias("_batch"),
    )
    path = scratch_path(rows.sparkSession, "batches")
    # Written by batch: a step reads the files of its batch alone.
    table.write.partitionBy("_batch").parquet(path)
    table = rows.sparkSession.read.parquet(path)
    width, tasks = shape["width"], table.rdd.getNumPartitions()

    net = initial(width, s.hidden, n_classes, s.seed)
    rate, step = s.learning_rate, 0
    first, second = np.zeros(len(net.flat())), np.zeros(len(net.flat()))
    best, since, since_rate = (np.inf, net), 0, 0
    for epoch in range(s.epochs + 1):
        order = np.random.default_rng([s.seed, epoch]).permutation(s.batches)
        seen = {"loss": 0.0, "n": 0.0}
        for i, b in enumerate(order.tolist()):
            got = _step(table, tasks, net, width, b, step, s)
            if i == 0:  # the validation rows met the weights that the last epoch left
                held = got["held_loss"] / got["held_n"]
                if epoch:
                    net.history[-1].update(val_loss=held, val_accuracy=got["right"] / got["held_n"])
                    better = held < best[0]
                    best = (held, net.like(net.flat())) if better else best
                    since, since_rate = (0, 0) if better else (since + 1, since_rate + 1)
                    if since_rate >= s.rate_patience:
                        rate, since_rate = max(rate * s.rate_factor, s.least_rate), 0
                if epoch == s.epochs or since >= s.patience:
                    return Network(best[1].weights, net.history)
            if got["n"]:
                step += 1
                gradient = got["gradient"] / got["n"]
                first = 0.9 * first + 0.1 * gradient
                second = 0.999 * second + 0.001 * gradient**2
                change = (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-7)
                net = net.like(net.flat() - rate * change)
            seen = {k: seen[k] + got[k] for k in seen}
        net.history.append({"epoch": epoch + 1, "loss": seen["loss"] / max(seen["n"], 1), "learning_rate": rate})
    raise AssertionError("the last epoch returns")


def predict(net: Network, df: DataFrame, features: str, name: str = "probabilities") -> DataFrame:
    """Adds the probability array and ``prediction`` (the first of the largest); null without features."""
    width = net.shapes[0][0]

    @F.pandas_udf("array<double>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vec in batches:
            out, there = [None] * len(vec), np.flatnonzero(vec.notna())
            if len(there):
                x = np.stack(vec.iloc[there].to_numpy()).astype(np.float64).reshape(-1, width)
                for i, p in zip(there.tolist(), net.forward(x)[2]):
                    out[i] = p
            yield pd.Series(out, dtype="object")

    return df.withColumn(name, scored(F.col(features))).withColumn("prediction", v.argmax(name))
