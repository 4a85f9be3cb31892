"""Repair of a group-atomic split: groups change places until every class is inside the band.

Groups are placed by prefix sums first (``splits``); classes of few or uneven groups can then miss their shares. A
round looks at all groups once and keeps, for each pair of splits, the moves with the largest marginal gain: a table
of bounded size. On those the driver exchanges groups (moves and swaps, no move undone for some steps), and the next
round starts from there. A table of so few groups that all splits can be tried is solved exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import seeded_key
from ..params import PROPORTION_TOLERANCE, RATIOS
from ..session import cut_lineage
from .ordered import join_keys, small_side, top_n

#: Assignments that are tried one by one.
EXHAUSTIVE = 200_000
#: Steps of one search, and for how many of them a group stays where it was put.
STEPS, TENURE = 120, 7


class Band:
    """How far class counts by split are from their shares: beyond ``limit`` first, then in all."""

    def __init__(self, totals: np.ndarray, targets: np.ndarray, limit: float):
        self.totals, self.targets, self.limit = np.maximum(totals, 1), targets, limit

    def cost(self, counts: np.ndarray, split: int) -> np.ndarray:
        """Cost of counts (... x classes) in one split."""
        far = np.abs(counts / self.totals - self.targets[split])
        return (np.maximum(far - self.limit, 0) ** 2).sum(axis=-1) + 1e-4 * (far**2).sum(axis=-1)

    def costs(self, counts: np.ndarray) -> np.ndarray:
        return np.array([self.cost(counts[s], s) for s in range(len(self.targets))])

    def deviation(self, counts: np.ndarray) -> float:
        return float(np.abs(counts / self.totals - self.targets[:, None]).max(initial=0.0))


def all_splits(band: Band, vectors: np.ndarray) -> np.ndarray:
    """The cheapest place of each group, out of all; ``vectors`` is groups x classes."""
    n, k = len(vectors), len(band.targets)
    places = np.array(list(product(range(k), repeat=n)), np.int8).reshape(-1, n)
    cost = sum(band.cost((places == s) @ vectors, s) for s in range(k))
    return places[int(cost.argmin())].astype(np.int64)


def exchange(band: Band, counts: np.ndarray, vectors: np.ndarray, place: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Better places of some groups, given the counts (splits x classes) of all: the best state a search meets."""
    counts, place = counts.astype(np.int64).copy(), place.copy()
    m, k = len(vectors), len(band.targets)
    best, best_place = band.costs(counts).sum(), place.copy()
    free = np.zeros(m, np.int64)
    for step in range(steps):
        if band.deviation(counts) <= band.limit:
            return place
        base = band.costs(counts)
        options = []  # (change, group, split, other group)
        for s in range(k):
            here = np.flatnonzero(place == s)
            if not len(here):
                continue
            left = band.cost(counts[s] - vectors[here], s) - base[s]
            for t in range(k):
                if t == s:
                    continue
                change = left + band.cost(counts[t] + vectors[here], t) - base[t]
                options.append((change, here, t, None))
                there = np.flatnonzero(place == t)
                if s < t and len(there):
                    both = vectors[there][None] - vectors[here][:, None]
                    change = band.cost(counts[s] + both, s) - base[s] + band.cost(counts[t] - both, t) - base[t]
                    options.append((change, here, t, there))
        chosen = None
        for change, here, t, there in options:
            change = change.copy()
            change[free[here] > step] = np.inf
            if there is not None:
                change[:, free[there] > step] = np.inf
            at = np.unravel_index(int(change.argmin()), change.shape)
            if np.isfinite(change[at]) and (chosen is None or change[at] < chosen[0]):
                chosen = change[at], here[at[0]], t, None if there is None else there[at[1]]
        if chosen is None:
            break
        _, i, t, j = chosen
        s = place[i]
        counts[s] -= vectors[i]
        counts[t] += vectors[i]
        place[i], free[i] = t, step + 1 + TENURE
        if j is not None:
            counts[t] -= vectors[j]
            counts[s] += vectors[j]
            place[j], free[j] = s, step + 1 + TENURE
        now = band.costs(counts).sum()
        if now < best - 1e-15:
            best, best_place = now, place.copy()
    return best_place


def _candidates(table: DataFrame, group: str, splits: list[str], classes: list, band: Band, counts: np.ndarray, width: int, seed: int):
    """The ``width`` best moves for each (from, to), as (group, split, vector)."""
    n, base = len(classes), band.costs(counts)

    def gains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            vectors = np.array(b["_v"].tolist(), np.int64).reshape(-1, n)
            at = b["_s"].to_numpy()
            leave = np.zeros(len(b))
            for s in range(len(splits)):
                mine = at == s
                leave[mine] = band.cost(counts[s] - vectors[mine], s) - base[s]
            for t in range(len(splits)):
                out = b[[group, "_s", "_v"]].assign(_t=t, _gain=-(leave + band.cost(counts[t] + vectors, t) - base[t]))
                yield out[at != t]

    schema = f"{table.select(group)._jdf.schema().toDDL()}, _s int, _v array<bigint>, _t int, _gain double"
    moves = table.mapInPandas(gains, schema)
    order = [F.desc("_gain"), seeded_key(seed, group), F.col(group)]
    return top_n(moves, ["_s", "_t"], order, width, [group]).collect()


def repair_split(
    clips: DataFrame,
    groups: DataFrame,
    group: str,
    cls: str,
    ratios: Mapping[str, float] = RATIOS,
    limit: float = PROPORTION_TOLERANCE,
    rounds: int = 8,
    width: int = 40,
    seed: int = 42,
) -> DataFrame:
    """``groups`` with ``split`` changed where that brings the classes' shares into the band.

    ``clips``: group and class of each clip; ``groups``: group and its split, one row a group, other columns are kept.
    A split that is inside the band is returned as it is. Where no exchange helps any more the best state found is
    returned: ``splits.max_proportion_deviation`` reports, or refuses, what is left. Groups of a null class, of no
    clip or of an unknown split stay where they are. The classes' number is that of the taxonomy.
    """
    splits = list(ratios)
    sizes = clips.filter(F.col(cls).isNotNull()).groupBy(group, cls).agg(F.count(F.lit(1)).alias("_k"))
    sizes = cut_lineage(sizes)
    totals = {r[cls]: r["n"] for r in sizes.groupBy(cls).agg(F.sum("_k").alias("n")).collect()}
    classes = sorted(totals)
    if not classes:
        return groups
    per_class = [F.sum(F.when(F.col(cls) == c, F.col("_k")).otherwise(0)) for c in classes]
    place = F.array_position(F.array(*[F.lit(s) for s in splits]), F.col("split")).cast("int") - 1
    table = join_keys(sizes.groupBy(group).agg(F.array(*per_class).alias("_v")), groups.select(group, place.alias("_s")), [group])
    table = cut_lineage(table.filter("_s >= 0"))
    sums = [F.sum(F.col("_v")[i]).alias(f"c{i}") for i in range(len(classes))]
    counts = np.zeros((len(splits), len(classes)), np.int64)
    n = 0
    for row in table.groupBy("_s").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        counts[row["_s"]] = [row[f"c{i}"] for i in range(len(classes))]
        n += row["n"]
    band = Band(np.array([totals[c] for c in classes]), np.array([ratios[s] for s in splits]), limit)
    moved: dict = {}
    small = len(splits) ** n <= EXHAUSTIVE
    current = table
    for _ in range(rounds):
        if band.deviation(counts) <= limit:
            break
        if small:
            rows = [(r[group], r["_s"], r["_v"]) for r in current.collect()]
        else:
            found = _candidates(current, group, splits, classes, band, counts, width, seed)
            rows = list({r[group]: (r[group], r["_s"], r["_v"]) for r in found}.values())
        vectors = np.array([x for _, _, x in rows], np.int64)
        before = np.array([s for _, s, _ in rows])
        after = all_splits(band, vectors) if small else exchange(band, counts, vectors, before)
        change = np.zeros_like(counts)
        np.subtract.at(change, before, vectors)
        np.add.at(change, after, vectors)
        if band.costs(counts + change).sum() >= band.costs(counts).sum() - 1e-15:
            break
        counts = counts + change
        moved.update({rows[i][0]: int(after[i]) for i in np.flatnonzero(before != after).tolist()})
        current = _moved(table, moved, group)
    if not moved:
        return groups
    named = F.get(F.array(*[F.lit(s) for s in splits]), F.col("_to"))
    out = join_keys(groups, _table_of(groups, moved, group), [group], "left")
    return out.withColumn("split", F.coalesce(named, F.col("split"))).select(*groups.columns)


def _table_of(groups: DataFrame, moved: dict, group: str) -> DataFrame:
    schema = f"{groups.select(group)._jdf.schema().toDDL()}, _to int"
    return small_side(groups.sparkSession.createDataFrame(list(moved.items()), schema))


def _moved(table: DataFrame, moved: dict, group: str) -> DataFrame:
    out = join_keys(table, _table_of(table, moved, group), [group], "left")
    return out.withColumn("_s", F.coalesce("_to", "_s")).select(*table.columns)
