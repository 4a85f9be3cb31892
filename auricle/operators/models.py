"""Embeddings and heads: pooling, scaling, linear and MLP heads, scoring, scoreboards."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..functions.columns import messages, seeded_key
from ..session import cut_lineage
from .checks import DataContractError
from .ordered import top_n

#: Largest parameter matrix (rows x columns) that may be sent to every executor.
MAX_MATRIX_CELLS = 5_000_000
MAX_MATRIX_ROWS = 100_000


def collect_matrix(df: DataFrame, key: str, vector: str) -> tuple[list, np.ndarray]:
    """(keys, matrix) of a small parameter table, refused above the size bounds."""
    df = cut_lineage(df)
    size = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("d"), F.min(F.size(vector)).alias("d0")).first()
    if not size["n"]:
        raise DataContractError("empty parameter table")
    if size["n"] > MAX_MATRIX_ROWS or size["n"] * size["d"] > MAX_MATRIX_CELLS or size["d"] != size["d0"]:
        raise DataContractError(f"parameter table of {size['n']} rows x {size['d0']}..{size['d']} is not a small matrix")
    rows = df.orderBy(key).select(key, vector).collect()
    return [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64)


def mean_vectors(df: DataFrame, keys: Sequence[str], values: str, name: str) -> DataFrame:
    """Element-wise mean per key as an array, and the row count; combined map-side, nothing exploded."""
    vec = array_to_vector(F.col(values))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.mean(vec)).alias(name)
    )


def embedding_pool(frames: DataFrame, clip: str, values: str) -> DataFrame:
    """Mean and population deviation over the frames of each clip, and their number."""
    vec = array_to_vector(F.col(values))
    stats = frames.groupBy(clip).agg(
        F.count(F.lit(1)).alias("n_frames"),
        Summarizer.metrics("mean", "variance").summary(vec).alias("_s"),
    )
    # The summarizer's variance is the sample one.
    n = F.col("n_frames")
    std = F.transform(vector_to_array(F.col("_s.variance")), lambda x: F.sqrt(x * (n - 1) / n))
    return stats.select(clip, "n_frames", vector_to_array(F.col("_s.mean")).alias("embed_mean"), std.alias("embed_std"))


def embedding_index_check(
    index: DataFrame, expected: DataFrame, clip: str, values: str, dim: int, n_classes: int, splits: Sequence[str]
) -> DataFrame:
    """One row of counts: clips lost, unexpected or repeated, other class or split, bad class or dimension."""
    want = expected.select(clip, F.col("class_id").alias("_c"), F.col("split").alias("_s"))
    got = index.groupBy(clip).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("class_id").alias("class_id"),
        F.min("split").alias("split"),
        F.count_if(F.coalesce(F.size(values), F.lit(-1)) != dim).alias("_dim"),
        F.count_if(~F.col("class_id").between(0, n_classes - 1)).alias("_class"),
        F.count_if(~F.col("split").isin(*splits)).alias("_split"),
    )
    both = want.join(got, clip, "full_outer")
    present = F.col("_n").isNotNull() & F.col("_c").isNotNull()
    return both.agg(
        F.count_if(F.col("_n").isNull()).alias("missing"),
        F.count_if(F.col("_c").isNull()).alias("unexpected"),
        F.count_if(F.coalesce(F.col("_n"), F.lit(1)) > 1).alias("repeated"),
        F.count_if(present & (F.col("_c") != F.col("class_id"))).alias("class_differs"),
        F.count_if(present & (F.col("_s") != F.col("split"))).alias("split_differs"),
        F.coalesce(F.sum("_dim"), F.lit(0)).alias("wrong_dimension"),
        F.coalesce(F.sum("_class"), F.lit(0)).alias("class_out_of_range"),
        F.coalesce(F.sum("_split"), F.lit(0)).alias("split_out_of_range"),
    )


@dataclass(frozen=True)
class Scaler:
    """Per-dimension mean and population deviation of the train rows (1 where constant)."""

    mean: np.ndarray
    scale: np.ndarray

    @staticmethod
    def fit(train: DataFrame, values: str) -> Scaler:
        vec = array_to_vector(F.col(values))
        row = train.select(Summarizer.metrics("mean", "variance", "count").summary(vec).alias("s")).select("s.*").first()
        n = row["count"]
        if not n:
            raise DataContractError("no training rows to fit the scaler on")
        std = np.sqrt(row["variance"].toArray() * (n - 1) / n)
        return Scaler(row["mean"].toArray(), np.where(std > 0, std, 1.0))

    def apply(self, df: DataFrame, values: str, name: str) -> DataFrame:
        mean, scale = self.mean, self.scale

        @F.pandas_udf("array<double>")
        def scaled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for vec in batches:
                x = np.stack(vec.to_numpy()).astype(np.float64) if len(vec) else np.empty((0, len(mean)))
                yield pd.Series(list((x - mean) / scale), dtype="object")

        return df.withColumn(name, scaled(F.col(values)))


def logistic_head(
    train: DataFrame, features: str, label: str, c: float = 1.0, max_iter: int = 100, weight: str | None = None,
    tol: float = 1e-6,
):
    """Fit a multinomial logistic head with penalty 1 / (2 C) on already scaled features."""
    n = train.count()
    model = LogisticRegression(
        featuresCol="_x", labelCol=label, family="multinomial", regParam=1.0 / (c * n), elasticNetParam=0.0,
        standardization=False, maxIter=max_iter, tol=tol, probabilityCol="_p", predictionCol="_pred", rawPredictionCol="_raw",
        **({"weightCol": weight} if weight else {}),
    )
    return model.fit(train.withColumn("_x", array_to_vector(F.col(features))))


def mlp_head(train: DataFrame, features: str, label: str, hidden: int, dim: int, n_classes: int, seed: int, max_iter: int = 100):
    """Fit dim -> hidden -> softmax (Spark's perceptron: sigmoid hidden units, no dropout)."""
    model = MultilayerPerceptronClassifier(
        featuresCol="_x", labelCol=label, layers=[dim, hidden, n_classes], seed=seed, maxIter=max_iter,
        probabilityCol="_p", predictionCol="_pred", rawPredictionCol="_raw",
    )
    return model.fit(train.withColumn("_x", array_to_vector(F.col(features))))


def predict(model, df: DataFrame, features: str, name: str = "probabilities") -> DataFrame:
    """Probability array and predicted class of each row."""
    out = model.transform(df.withColumn("_x", array_to_vector(F.col(features))))
    return out.withColumns({name: vector_to_array("_p"), "prediction": F.col("_pred").cast("int")}).drop(
        "_x", "_p", "_pred", "_raw"
    )


def stack_head(train: DataFrame, stack: str, label: str, n_classes: int, second: str = "logistic", **settings):
    """The second stage over the outputs of the first: a logistic head, or a perceptron with ``hidden`` units."""
    if second == "logistic":
        return logistic_head(train, stack, label, **settings)
    if second == "mlp":
        return mlp_head(train, stack, label, dim=n_classes, n_classes=n_classes, **settings)
    raise DataContractError(f"unknown second stage {second!r}")


def binary_stack_outputs(
    df: DataFrame, features: str, label: str, n_classes: int, max_iter: int = 20, tol: float = 1e-6
) -> DataFrame:
    """One balanced one-against-rest model per class fitted on train; their outputs as one array per row.

    ``df`` carries split. The loop is over classes (a handful), each fit being a Spark job.
    """
    # Every fit reads the same rows many times: fix them once.
    rows = cut_lineage(df.withColumn("_x", array_to_vector(F.col(features))))
    total = rows.filter("split = 'train'").count()
    counts = {r[label]: r["count"] for r in rows.filter("split = 'train'").filter(F.col(label).between(0, n_classes - 1)).groupBy(label).count().collect()}
    missing = [k for k in range(n_classes) if not counts.get(k)]
    if missing:
        raise DataContractError(f"no training rows for classes {missing}")
    out = rows
    for k in range(n_classes):
        pos = counts[k]
        target = (F.col(label) == k).cast("double")
        weight = F.when(F.col(label) == k, total / (2.0 * pos)).otherwise(total / (2.0 * max(total - pos, 1)))
        train = rows.filter("split = 'train'").withColumns({"_y": target, "_w": weight})
        model = LogisticRegression(
            featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=max_iter, tol=tol, standardization=False,
            regParam=1.0 / total, probabilityCol=f"_p{k}", predictionCol=f"_c{k}", rawPredictionCol=f"_r{k}",
        ).fit(train)
        out = model.transform(out).drop(f"_c{k}", f"_r{k}")
    z = F.array(*[F.get(vector_to_array(f"_p{k}"), F.lit(1)) for k in range(n_classes)])
    return out.withColumn("stack", z).drop("_x", *[f"_p{k}" for k in range(n_classes)])


def zero_shot_scores(scores: str, mapping: Mapping[str, Sequence[int]], names: Sequence[str]) -> Column:
    """Per own class, the sum of its mapped external scores (0 where none is mapped)."""
    x = F.col(scores)

    def one(name: str) -> Column:
        total = F.lit(0.0)
        for i in mapping.get(name, ()):
            total = total + F.get(x, F.lit(i)).cast("double")
        return total

    return F.array(*[one(n) for n in names])


def unmapped_classes(mapping: Mapping[str, Sequence[int]], names: Sequence[str]) -> list[str]:
    return [n for n in names if not mapping.get(n)]


@dataclass(frozen=True)
class LinearHead:
    """Scaler and coefficients of a saved linear head."""

    scaler: Scaler
    class_ids: list
    coef: np.ndarray
    intercept: np.ndarray

    @staticmethod
    def load(coefficients: DataFrame, scaler: Scaler, cls: str = "class_id") -> LinearHead:
        """From a table (class_id, intercept, coef array)."""
        joint = coefficients.select(cls, F.concat(F.array(F.col("intercept").cast("double")), v.doubles("coef")).alias("w"))
        ids, w = collect_matrix(joint, cls, "w")
        return LinearHead(scaler, ids, w[:, 1:], w[:, 0])

    def score(self, df: DataFrame, values: str, name: str = "probabilities") -> DataFrame:
        """Softmax probabilities in class order; one matrix product per Arrow batch."""
        shared = df.sparkSession.sparkContext.broadcast(
            (self.scaler.mean, self.scaler.scale, self.coef, self.intercept)
        )

        @F.pandas_udf("array<double>")
        def softmax(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            mean, scale, coef, intercept = shared.value
            for vec in batches:
                x = np.stack(vec.to_numpy()).astype(np.float64) if len(vec) else np.empty((0, len(mean)))
                z = ((x - mean) / scale) @ coef.T + intercept
                e = np.exp(z - z.max(axis=1, keepdims=True, initial=-np.inf))
                yield pd.Series(list(e / e.sum(axis=1, keepdims=True)), dtype="object")

        return df.withColumn(name, softmax(F.col(values)))


def argmax_label(probabilities: str, names: Sequence[str]) -> dict[str, Column]:
    """Index, label and confidence of the most probable class; the lowest index on ties."""
    index = v.argmax(probabilities)
    labels = F.array(*[F.lit(n) for n in names])
    return {
        "index": index,
        "label": F.element_at(labels, index + 1),
        "confidence": F.array_max(probabilities),
    }


def topk_labels(df: DataFrame, key: str, probabilities: str, names: Sequence[str], k: int = 3) -> DataFrame:
    """The k best labels of each row, best first, one row each."""
    labels = F.array(*[F.lit(n) for n in names])
    best = v.top_k(probabilities, labels, k)
    return df.select(key, F.posexplode(best).alias("rank", "b")).select(key, "rank", "b.*")


def model_contract_check(coefficients: DataFrame, taxonomy: DataFrame, dim: int) -> DataFrame:
    """Rows of a coefficient table (class_id, class_name, coef) that do not fit the taxonomy."""
    t = taxonomy.select("class_id", F.col("class_name").alias("_want"))
    both = coefficients.groupBy("class_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("class_name").alias("class_name"),
        F.min(F.size("coef")).alias("_lo"),
        F.max(F.size("coef")).alias("_hi"),
    ).join(t, "class_id", "full_outer")
    problems = messages(
        (F.col("_n").isNull(), "class_missing"),
        (F.col("_want").isNull(), "class_unknown"),
        (F.col("_n") > 1, "class_repeated"),
        (F.col("class_name") != F.col("_want"), "name_differs"),
        ((F.col("_lo") != dim) | (F.col("_hi") != dim), "wrong_dimension"),
    )
    return both.select("class_id", F.explode(problems).alias("problem"))


def batch_score_quarantine(df: DataFrame, key: str, values: str, head: LinearHead, name: str = "prediction") -> DataFrame:
    """Score every row; a row that cannot be scored keeps its key and carries the reason."""
    shared = df.sparkSession.sparkContext.broadcast((head.scaler.mean, head.scaler.scale, head.coef, head.intercept))

    def reason(x, dim: int) -> str | None:
        if x is None:
            return "missing"
        if len(x) != dim:
            return f"dimension {len(x)} != {dim}"
        return None if np.isfinite(np.asarray(x, dtype=np.float64)).all() else "non-finite value"

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mean, scale, coef, intercept = shared.value
        for pdf in parts:
            errors = [reason(x, len(mean)) for x in pdf[values]]
            good = np.array([e is None for e in errors], dtype=bool)
            index = pd.Series(pd.NA, index=pdf.index, dtype="Int32")
            if good.any():
                x = np.stack(pdf.loc[good, values].to_numpy()).astype(np.float64)
                index[good] = ((x - mean) / scale @ coef.T + intercept).argmax(axis=1)
            yield pd.DataFrame({key: pdf[key], name: index, "error": errors})

    schema = f"{key} {df.schema[key].dataType.simpleString()}, {name} int, error string"
    return df.select(key, values).mapInPandas(batches, schema)


def pool_sample(
    splits: DataFrame, ledger: DataFrame, key: str, n: int, seed: int, expected: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(seeded sample of n kept validation clips, validation clips without a kept ledger row)."""
    val = splits.filter(F.col("split") == "val").select(key)
    kept = ledger.filter(F.col("status") == "kept")
    pool = kept.join(val, key, "left_semi")
    unmatched = val.join(kept.select(key), key, "left_anti")
    size = pool.count()
    if expected is not None and size != expected:
        raise DataContractError(f"validation pool holds {size} clips, expected {expected}")
    if not 1 <= n <= size:
        raise DataContractError(f"cannot draw {n} of {size} clips")
    keyed = pool.withColumn("_key", seeded_key(seed, key))
    return top_n(keyed, [], [F.col("_key"), F.col(key)], n, [key]).drop("_key"), unmatched


def class_scoreboard(pool: DataFrame, shown: DataFrame, taxonomy: DataFrame, total_name: str = "TOTAL") -> DataFrame:
    """Per class: pool, shown, correct, wrong, errors, accuracy, precision, recall, F1; and the TOTAL row.

    ``pool`` has class_name; ``shown`` has class_name, predicted (null on error). A rate
    without cases is null, and TOTAL averages the defined rates only.
    """
    hit = F.col("predicted") == F.col("class_name")
    own = shown.groupBy("class_name").agg(
        F.count(F.lit(1)).alias("shown"),
        F.count_if(hit).alias("correct"),
        F.count_if(~hit).alias("wrong"),
        F.count_if(F.col("predicted").isNull()).alias("errors"),
    )
    false_pos = shown.filter(~hit).groupBy(F.col("predicted").alias("class_name")).agg(F.count(F.lit(1)).alias("fp"))
    sizes = pool.groupBy("class_name").agg(F.count(F.lit(1)).alias("pool"))
    counts = ("pool", "shown", "correct", "wrong", "errors", "fp")
    rows = (
        taxonomy.select("class_name")
        .join(sizes, "class_name", "left")
        .join(own, "class_name", "left")
        .join(false_pos, "class_name", "left")
        .na.fill(0, subset=list(counts))
    )
    correct, wrong = F.col("correct"), F.col("wrong")
    precision = F.try_divide(correct, correct + F.col("fp"))
    recall = F.try_divide(correct, correct + wrong)
    rows = rows.withColumns({"accuracy": recall, "precision": precision, "recall": recall}).withColumn(
        "f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )
    total = rows.agg(
        *[F.sum(c).alias(c) for c in counts],
        *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")],
    ).select(
        F.lit(total_name).alias("class_name"),
        *counts,
        F.try_divide("correct", "shown").alias("accuracy"),
        "precision",
        "recall",
        "f1",
    )
    return rows.unionByName(total)


def run_comparison(runs: Mapping[str, DataFrame], metric: str) -> DataFrame:
    """Metric rows of several runs side by side; the best run on ``metric`` is marked."""
    out = None
    for name, row in runs.items():
        named = row.withColumn("run", F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    best = out.agg(F.min(F.struct((-F.col(metric)).alias("neg"), "run"))["run"].alias("b")).scalar()
    return out.withColumn("best", F.col("run") == best)


def metric_reproduction_check(actual: DataFrame, expected: DataFrame, tolerance: float) -> DataFrame:
    """(metric, expected, actual, ok) with an absolute tolerance; an absent metric is not ok."""
    both = expected.select("metric", F.col("value").alias("expected")).join(
        actual.select("metric", F.col("value").alias("actual")), "metric", "left"
    )
    return both.withColumn("ok", F.coalesce(F.abs(F.col("actual") - F.col("expected")) <= tolerance, F.lit(False)))
