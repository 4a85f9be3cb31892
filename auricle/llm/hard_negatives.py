"""Hard negatives by Fagin's threshold algorithm.

Candidates are dealt to blocks. A block holds, for each dimension, its candidates sorted by that component. An
anchor reads a dimension's list from the top where its own component is positive and from the bottom where it is
negative, so the products it has not seen yet only fall. Every candidate met in any list is scored in whole (random
access, exact integers). The threshold is the sum of the products at the places reached: nothing unseen scores more.
A window (scores from ``lo`` to ``hi``) is closed once the threshold is strictly below its k-th score, or below
``lo``; an anchor stops when all of its windows are closed. Strictly, because an unseen candidate of the k-th score
may have a smaller id.

Anchors of a block advance together: lists are read in doubling depths, and what they meet is scored for all anchors
still searching by one product. A block's answer is exact for the block; the best of all blocks are ranked after one
shuffle of at most k rows a window and block.

First the positives are searched, among blocks of the anchor's own label, then the negatives, among blocks of all
rows, with one window for each positive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import small_side
from .common import materialize

#: Anchors that advance together, and the depth of their first reading.
CHUNK, FIRST_DEPTH = 128, 8


@dataclass(frozen=True)
class Settings:
    """``positives`` of each anchor, ``negatives`` of each positive, whose scores lie between ``low`` and ``high`` per
    cent of the positive's. A block holds about ``block_values`` components, a task scores one block for about
    ``anchors`` anchors."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    block_values: int = 1 << 19
    anchors: int = 512

    def block_rows(self, width: int) -> int:
        return max(1, self.block_values // max(width, 1))


def quantise(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as a long; null for a null vector or one with a component that is null or
    not finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, shorter ones padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _exact(bound: int) -> type:
    """The fastest type that adds products of at most ``bound`` in all without rounding."""
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object


@dataclass(frozen=True)
class Found:
    query: np.ndarray
    window: np.ndarray
    candidate: np.ndarray
    score: np.ndarray


class Block:
    """Sorted lists of a block's candidates. Candidates are in the order that decides ties."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, self.order, axis=0)
        self.most = int(np.abs(vectors).max(initial=0))

    def search(self, queries: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, eligible: Callable) -> Found:
        """The k best candidates of each query and window, best first.

        ``lo`` and ``hi`` (queries x windows, Python integers) bound the scores; ``eligible(queries, candidates)``
        gives the mask of pairs that count. A pair's key is ``score * m + m - 1 - candidate``: larger is better.
        """
        m = len(self.vectors)
        bound = int(np.abs(queries).sum(axis=1).max(initial=0)) * self.most
        kind = _exact(bound)
        key_kind = np.int64 if (bound + 2) * (m + 1) < 1 << 62 else object
        vectors, q = self.vectors.astype(kind), queries.astype(kind)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        low, high = (np.clip(x, -bound - 1, bound + 1).astype(key_kind) for x in (lo, hi))
        none = -(bound + 2) * m
        best = np.full((*lo.shape, k), none, key_kind)
        active = np.flatnonzero((lo <= hi).any(axis=1)) if m else np.zeros(0, np.int64)
        seen, depth = np.zeros(m, bool), FIRST_DEPTH
        while len(active):
            depth = min(depth, m)
            met = np.full(m, depth == m)
            met[self.order[m - depth :, (q[active] > 0).any(axis=0)]] = True
            met[self.order[:depth, (q[active] < 0).any(axis=0)]] = True
            fresh = np.flatnonzero(met & ~seen)
            seen |= met
            scores = (q[active] @ vectors[fresh].T).astype(key_kind)
            keys = scores * m + (m - 1 - fresh)
            keys[~eligible(active, fresh)] = none
            for w in range(lo.shape[1]):
                inside = (scores >= low[active, w, None]) & (scores <= high[active, w, None])
                joined = np.concatenate([best[active, w], np.where(inside, keys, none)], axis=1)
                best[active, w] = np.sort(np.partition(joined, -k, axis=1)[:, -k:], axis=1)[:, ::-1]
            if seen.all():
                break
            top, bottom = self.sorted[m - depth].astype(kind), self.sorted[depth - 1].astype(kind)
            threshold = (up[active] @ top + down[active] @ bottom).astype(key_kind)
            kth = best[active, :, -1]
            needed = np.where(kth == none, low[active], kth // m)
            closed = (threshold[:, None] < needed) | (lo[active] > hi[active])
            active = active[~closed.all(axis=1)]
            depth *= 2
        query, window, place = np.nonzero(best != none)
        keys = best[query, window, place]
        return Found(query, window, (m - 1 - keys % m).astype(np.int64), keys // m)


_FOUND = "anchor long, positive long, vec_id long, row long, score long"


def _searcher(width: int, k: int, windows: Callable, differ: bool) -> Callable:
    """Searches one block for its anchors. ``windows(anchors)`` gives (lo, hi) of each anchor's windows."""

    def search(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        rows, ids = (candidates.column(c).to_numpy() for c in ("row", "vec_id"))
        ties = np.lexsort((rows, ids))
        rows, ids = rows[ties], ids[ties]
        labels = np.array(candidates.column("label").to_pylist(), object)[ties]
        block = Block(matrix(candidates.column("vec"), width)[ties])
        queries = matrix(anchors.column("vec"), width)
        keys = anchors.column("row").to_numpy()
        codes, _ = pd.factorize(np.concatenate([labels, np.array(anchors.column("label").to_pylist(), object)]))
        theirs, own = codes[: len(rows)], codes[len(rows) :]
        lo, hi = windows(anchors)
        out = [pa.table({n: pa.array([], pa.int64()) for n in ("anchor", "positive", "vec_id", "row", "score")})]
        for start in range(0, len(keys), CHUNK):
            part = slice(start, start + CHUNK)

            def eligible(active, fresh, part=part):
                if differ:
                    return own[part][active, None] != theirs[fresh]
                return (own[part][active, None] == theirs[fresh]) & (keys[part][active, None] != rows[fresh])

            found = block.search(queries[part], lo[part], hi[part], k, eligible)
            out.append(
                pa.table(
                    {
                        "anchor": pa.array(keys[part][found.query], pa.int64()),
                        "positive": pa.array(found.window, pa.int64()),
                        "vec_id": pa.array(ids[found.candidate], pa.int64()),
                        "row": pa.array(rows[found.candidate], pa.int64()),
                        "score": pa.array(found.score.tolist(), pa.int64()),
                    }
                )
            )
        return pa.concat_tables(out)

    return search


def _everything(anchors: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    far = np.full((len(anchors), 1), 1 << 200, object)
    return -far, far


def _between(low: int, high: int, windows: int) -> Callable:
    """Scores from ``low`` to ``high`` per cent of each positive's; an anchor with fewer positives has empty windows."""

    def bounds(anchors: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        lo = np.full((len(anchors), windows), 1, object)
        hi = np.full((len(anchors), windows), 0, object)
        for i, scores in enumerate(anchors.column("positive_scores").to_pylist()):
            for w, score in enumerate(scores):
                lo[i, w], hi[i, w] = -(-low * score // 100), high * score // 100
        return lo, hi

    return bounds


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of all blocks. The limit is applied before the shuffle as well."""
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _dealt(key: Column | str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(key), parts)


def _numbers(n: Column) -> Column:
    """0 to n - 1, one row each; no row for none."""
    return F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>")))


def _apart(df: DataFrame) -> DataFrame:
    """The same rows under new column identities, so that a table can meet itself."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def mine(rows: DataFrame, every: int, settings: Settings | None = None) -> DataFrame:
    """Hard negatives of the rows whose ``vec_id`` is divisible by ``every``.

    ``rows``: ``vec_id`` long, ``label``, ``vec`` array of long (see ``quantise``). A score is an integer inner
    product; higher scores come first, ties by smaller ``vec_id``, then in the order of the table. An anchor's
    positives are its first other rows of the same label; its negatives, for each positive, the first rows of other
    labels whose score lies in the window. Returns ``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``; a positive without negatives has no row.

    A row with a null id, label or vector takes no part. Vectors of unlike lengths are padded with zeros; empty ones
    score 0. A repeated row is another row: a copy of an anchor is an anchor too, and may be its positive. Other
    columns are ignored, an empty table gives no rows. Scores that might leave the long range are an error.
    """
    s = settings or Settings()
    sound = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "vec").dropna()
    table = materialize(sound.withColumn("row", F.monotonically_increasing_id()), "candidates")
    size = table.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("vec_id") % every == 0).alias("anchors"),
        F.max(F.size("vec")).alias("width"),
        F.max(F.greatest(F.array_max("vec"), -F.array_min("vec"))).alias("most"),
    ).first()
    width = size.width or 0
    if (size.most or 0) ** 2 * width >= 1 << 63:
        raise ValueError(f"components up to {size.most}: scores of {width} dimensions may leave the long range")
    per_block = s.block_rows(width)
    anchors = table.where(F.col("vec_id") % every == 0)

    # Positives: blocks of one label, as many as its rows need.
    parts = small_side(
        table.groupBy("label").agg(
            F.ceil(F.count(F.lit(1)) / per_block).alias("_parts"),
            F.ceil(F.count_if(F.col("vec_id") % every == 0) / s.anchors).alias("_teams"),
        )
    )
    keys = ["label", "_part", "_team"]
    same = table.join(parts, "label").withColumn("_part", _dealt("row", F.col("_parts")))
    same = same.withColumn("_team", _numbers(F.col("_teams"))).drop("_parts", "_teams")
    asking = anchors.join(parts, "label").withColumn("_team", _dealt("row", F.col("_teams")))
    asking = asking.withColumn("_part", _numbers(F.col("_parts"))).drop("_parts", "_teams")
    found = (
        same.groupBy(*keys)
        .cogroup(_apart(asking).groupBy(*keys))
        .applyInArrow(_searcher(width, s.positives, _everything, differ=False), _FOUND)
    )
    best = F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score")))
    positives = _ranked(found, s.positives).groupBy("anchor").agg(best.alias("best"))
    positives = positives.select(
        F.col("anchor").alias("row"),
        F.col("best.vec_id").alias("positive_ids"),
        F.col("best.score").alias("positive_scores"),
    )
    positives = materialize(positives, "positives")

    # Negatives: blocks of all rows.
    blocks, teams = max(1, -(-size.n // per_block)), max(1, -(-size.anchors // s.anchors))
    keys = ["_part", "_team"]
    others = table.withColumn("_part", _dealt("row", F.lit(blocks))).withColumn("_team", _numbers(F.lit(teams).cast("long")))
    asking = anchors.join(positives, "row").withColumn("_team", _dealt("row", F.lit(teams)))
    asking = asking.withColumn("_part", _numbers(F.lit(blocks).cast("long")))
    found = (
        others.groupBy(*keys)
        .cogroup(_apart(asking).groupBy(*keys))
        .applyInArrow(_searcher(width, s.negatives, _between(s.low, s.high, s.positives), differ=True), _FOUND)
    )
    named = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")).join(
        positives.withColumnRenamed("row", "anchor"), "anchor"
    )
    return (
        _ranked(found, s.negatives)
        .join(named, "anchor")
        .select(
            "anchor_id",
            F.get("positive_ids", F.col("positive").cast("int")).alias("positive_id"),
            F.col("rank").cast("int").alias("rank"),
            F.col("vec_id").alias("negative_id"),
            F.get("positive_scores", F.col("positive").cast("int")).alias("positive_score"),
            F.col("score").alias("negative_score"),
        )
    )
