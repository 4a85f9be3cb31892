"""Expressions over ARRAY<FLOAT|DOUBLE> columns; no explode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_col


def doubles(c: str | Column) -> Column:
    return F.transform(as_col(c), lambda x: x.cast("double"))


def total(c: str | Column) -> Column:
    return F.aggregate(as_col(c), F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def mean(c: str | Column) -> Column:
    c = as_col(c)
    return total(c) / F.size(c)


def rms(c: str | Column) -> Column:
    c = as_col(c)
    sq = F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(sq / F.size(c))


def peak(c: str | Column) -> Column:
    return F.array_max(F.transform(as_col(c), lambda x: F.abs(x.cast("double"))))


def count_where(c: str | Column, predicate) -> Column:
    return F.size(F.filter(as_col(c), predicate))


def argmax(c: str | Column) -> Column:
    """0-based position of the largest entry; the lowest position on ties."""
    c = as_col(c)
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def rescale01(c: str | Column, lo: Column, hi: Column) -> Column:
    """clip((x - lo) / (hi - lo), 0, 1) element by element."""
    return F.transform(
        as_col(c),
        lambda x: F.least(F.greatest((x.cast("double") - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)),
    )


def power_to_db(c: str | Column, ref: float = 1.0, amin: float = 1e-10) -> Column:
    """10 log10(max(x, amin)) - 10 log10(max(ref, amin)), without a lower cut."""
    base = F.lit(max(ref, amin))
    return F.transform(
        as_col(c),
        lambda x: F.lit(10.0) * F.log10(F.greatest(x.cast("double"), F.lit(amin)))
        - F.lit(10.0) * F.log10(base),
    )


def top_k(probs: str | Column, names: Column, k: int) -> Column:
    """The k best (index, label, p) structs, best first; lower index first on ties."""
    probs = as_col(probs)
    ranked = F.array_sort(
        F.transform(
            probs,
            lambda p, i: F.struct((-p).alias("neg"), i.alias("index")),
        )
    )
    return F.transform(
        F.slice(ranked, 1, k),
        lambda s: F.struct(
            s["index"].alias("index"),
            F.element_at(names, s["index"] + 1).alias("label"),
            (-s["neg"]).alias("p"),
        ),
    )
