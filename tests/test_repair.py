"""Split repair against all assignments; exact p-values against all orders."""

import random
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest

from auricle.operators import repair, splits
from auricle.operators.checks import DataContractError
from auricle.operators.gates import exact_ks_p

RATIOS = {"train": 0.6, "val": 0.2, "test": 0.2}


def random_groups(seed, n, classes, most=6):
    r = random.Random(seed)
    return [[r.randint(0, most) if r.random() < 0.7 else 0 for _ in range(classes)] for _ in range(n)]


def band_of(vectors, limit=0.05):
    v = np.array(vectors)
    return repair.Band(v.sum(axis=0), np.array(list(RATIOS.values())), limit)


def counts_of(vectors, place):
    return np.array([np.array(vectors)[place == s].sum(axis=0) for s in range(3)])


def test_exchange_finds_what_brute_force_finds():
    """Seven to nine groups: wherever some assignment is inside the band, the exchanges find one, restarted from the
    repaired state as the rounds do; and ``all_splits`` always does."""
    found = feasible = 0
    for seed in range(60):
        vectors = np.array(random_groups(seed, 7 + seed % 3, 2, most=4) )
        if not vectors.sum(axis=0).all():
            continue
        band = band_of(vectors, 0.08)
        best = repair.all_splits(band, vectors)
        inside = band.deviation(counts_of(vectors, best)) <= band.limit
        # All assignments, plainly.
        places = np.array(np.meshgrid(*[range(3)] * len(vectors))).T.reshape(-1, len(vectors))
        sums = np.stack([(places == s) @ vectors for s in range(3)], axis=1)
        far = np.abs(sums / vectors.sum(axis=0) - band.targets[None, :, None]).max(axis=(1, 2))
        assert inside == bool((far <= band.limit).any())
        if inside:
            feasible += 1
            start = np.random.default_rng(seed).integers(0, 3, len(vectors))
            place = start
            for _ in range(4):
                place = repair.exchange(band, counts_of(vectors, place), vectors, place)
            found += band.deviation(counts_of(vectors, place)) <= band.limit
    assert feasible >= 10 and found >= 0.9 * feasible


def clips_of(spark, vectors):
    rows = [(f"g{i}", f"c{c}") for i, v in enumerate(vectors) for c, k in enumerate(v) for _ in range(k)]
    return spark.createDataFrame(rows, "g string, cls string")


def placed(spark, names, split="train"):
    rows = [(g, "kept", split) for g in names]
    return spark.createDataFrame(rows, "g string, note string, split string")


@pytest.mark.parametrize("groups, classes", [(8, 2), (60, 4)])
def test_repair_brings_classes_into_the_band(spark, groups, classes):
    """From everything in one split: a small table is solved exactly, a larger one by exchange rounds."""
    clips = clips_of(spark, random_groups(groups, groups, classes, most=9)).cache()
    names = [r.g for r in clips.select("g").distinct().collect()]
    start = placed(spark, [*names, "empty"])
    out = repair.repair_split(clips, start, "g", "cls", RATIOS, 0.05, width=12)
    assert out.columns == ["g", "note", "split"] and out.count() == len(names) + 1
    assert out.filter("g = 'empty' AND split = 'train' AND note = 'kept'").count() == 1
    worst = splits.max_proportion_deviation(splits.apply_split(clips, out, "g"), "cls", RATIOS).first()[0]
    if groups > 10:
        assert worst <= 0.05
    else:
        v = clips.groupBy("g").pivot("cls").count().na.fill(0).drop("g").toPandas().to_numpy()
        best = repair.all_splits(band_of(v), v)
        assert worst <= 0.05 or band_of(v).deviation(counts_of(v, best)) > 0.05
    again = repair.repair_split(clips, out, "g", "cls", RATIOS, max(worst, 0.05))
    assert sorted(again.collect()) == sorted(out.collect())
    clips.unpersist()


def test_what_no_split_can_meet_is_reported(spark):
    clips = clips_of(spark, [[10], [1], [1]])
    out = repair.repair_split(clips, placed(spark, ["g0", "g1", "g2"]), "g", "cls", RATIOS, 0.05)
    cut = splits.apply_split(clips, out, "g")
    with pytest.raises(DataContractError):
        splits.max_proportion_deviation(cut, "cls", RATIOS, 0.05)
    assert {r.g: r.split for r in out.collect()}["g0"] == "train"
    assert repair.repair_split(clips.where("false"), out, "g", "cls", RATIOS).count() == 3


def plain_p(a_size, b_size, d):
    """Share of all orders of both samples whose D is at least d."""
    n = hit = 0
    for places in combinations(range(a_size + b_size), a_size):
        own, i, j, most = set(places), 0, 0, Fraction(0)
        for k in range(a_size + b_size):
            i, j = i + (k in own), j + (k not in own)
            most = max(most, abs(Fraction(i, a_size) - Fraction(j, b_size)))
        n, hit = n + 1, hit + (most >= d)
    return hit / n


@pytest.mark.parametrize("n, m", [(2, 2), (2, 7), (5, 5), (4, 6), (7, 5), (3, 9)])
def test_exact_p_equals_all_orders(n, m):
    steps = sorted({abs(Fraction(i, n) - Fraction(j, m)) for i in range(n + 1) for j in range(m + 1)})
    for d in steps:
        assert exact_ks_p(float(d), n, m) == pytest.approx(plain_p(n, m, d), rel=1e-12)


def test_exact_p_of_larger_samples():
    assert exact_ks_p(0.0, 50, 60) == 1.0 and exact_ks_p(1.0, 50, 60) == pytest.approx(2 / float(__import__("math").comb(110, 50)), rel=1e-9)
    n, m, d = 4000, 3000, 0.03
    lam = (n * m / (n + m)) ** 0.5 * d
    series = 2 * sum((-1) ** (k - 1) * np.exp(-2 * k * k * lam * lam) for k in range(1, 100))
    assert exact_ks_p(d, n, m) == pytest.approx(series, rel=0.05)
    assert exact_ks_p(d, n, m) == exact_ks_p(d, m, n)
