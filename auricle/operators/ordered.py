"""Order-dependent work that stays exact when one key holds most of the rows.

A window partitioned by a class, a session or a source puts that whole key into one
task. The helpers here keep the answer exact and the tasks bounded:

* ``ordered_chunks`` range-partitions rows by (key, order), so that a large key is spread
  over many chunks, and fixes the chunk of each row with a reliable checkpoint;
* running sums, maxima and latest values are taken inside each chunk and completed by the
  summary of the chunks before it (one summary row per key and chunk);
* top-n per key is taken twice, first per salted part of the key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import cut_lineage

#: A key with more rows than this is not given to a single window task.
MAX_ROWS_PER_KEY = 5_000_000
#: A join side is broadcast only when it was counted to hold at most this many (narrow) rows.
MAX_BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a side counted to be small; beyond the bound the join is shuffled.

    Without it a table of unknown size (local rows, a checkpoint) would shuffle the large
    side on a key with few values.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def ordered_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Sort rows by (keys, order) into range partitions; adds ``_chunk`` and ``_pos``."""
    cols = [*keys, *order]
    ranged = (
        df.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    return (
        cut_lineage(ranged)
        .withColumn("_chunk", F.shiftright("_mid", 33))
        .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mid")
    )


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys where null meets null, so that rows without a key are not lost."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def _carry_window(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Dense 0-based position of each row inside its key, plus ``<name>_total`` rows per key."""
    rows = ordered_chunks(df, keys, order)
    starts = rows.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    starts = starts.withColumn(
        "_before", F.coalesce(F.sum("_n").over(_carry_window(keys)), F.lit(0))
    ).withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
    starts = small_side(cut_lineage(starts))
    return (
        join_keys(rows, starts, [*keys, "_chunk"])
        .withColumn(name, F.col("_before") + F.col("_pos") - F.col("_first"))
        .withColumn(f"{name}_total", F.col("_total"))
        .drop("_chunk", "_pos", "_n", "_first", "_before", "_total")
    )


@dataclass(frozen=True)
class Running:
    """One running aggregate; exclusive leaves the current row out.

    ``kind`` is "sum", "max" or "last", the latest non-null value. ``total`` adds a sum over
    the whole key as ``<name>_total``.
    """

    kind: str
    value: Column
    exclusive: bool = False
    total: bool = False


@dataclass(frozen=True)
class OrderedRows:
    """Rows of each key in order, scanned by one window per key or chunk by chunk."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    chunked: bool
    fixed: bool = False  # the rows are a checkpoint, or columns derived from one

    @staticmethod
    def of(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunked: bool = False) -> OrderedRows:
        rows = ordered_chunks(df, keys, order) if chunked else df
        return OrderedRows(rows, tuple(keys), tuple(order), chunked, fixed=chunked)

    def with_columns(self, **cols: Column) -> OrderedRows:
        return replace(self, df=self.df.withColumns(cols))

    def running(self, **specs: Running) -> OrderedRows:
        whole = Window.partitionBy(*self.keys)
        if not self.chunked:
            w = whole.orderBy(*self.order)
            totals = {f"{n}_total": F.sum(s.value).over(whole) for n, s in specs.items() if s.total}
            return self.with_columns(**{n: _windowed(s, w) for n, s in specs.items()}, **totals)
        # The rows feed both the scan and its summary: compute them once.
        rows = self.df.withColumns({f"_v_{n}": s.value for n, s in specs.items()})
        rows = rows if self.fixed else cut_lineage(rows)
        sums = rows.groupBy(*self.keys, "_chunk").agg(
            *[_summary(s.kind, F.col(f"_v_{n}")).alias(f"_t_{n}") for n, s in specs.items()]
        )
        w = _carry_window(self.keys)
        carry = sums.select(
            *self.keys,
            "_chunk",
            *[_aggregate(s.kind, F.col(f"_t_{n}")).over(w).alias(f"_c_{n}") for n, s in specs.items()],
            *[F.sum(f"_t_{n}").over(whole).alias(f"{n}_total") for n, s in specs.items() if s.total],
        )
        local = Window.partitionBy(*self.keys, "_chunk").orderBy("_pos")
        out = join_keys(rows, small_side(cut_lineage(carry)), [*self.keys, "_chunk"])
        joined = {}
        for n, s in specs.items():
            here = _windowed(replace(s, value=F.col(f"_v_{n}")), local)
            if s.kind == "sum":
                joined[n] = F.coalesce(F.col(f"_c_{n}"), F.lit(0)) + F.coalesce(here, F.lit(0))
            elif s.kind == "max":
                joined[n] = F.greatest(F.col(f"_c_{n}"), here)
            else:
                joined[n] = F.coalesce(here, F.col(f"_c_{n}"))
        drop = [f"_{p}_{n}" for n in specs for p in ("v", "c")]
        return replace(self, df=out.withColumns(joined).drop(*drop), fixed=False)

    def result(self) -> DataFrame:
        return self.df.drop("_chunk", "_pos") if self.chunked else self.df


def _aggregate(kind: str, value: Column) -> Column:
    return F.last(value, ignorenulls=True) if kind == "last" else getattr(F, kind)(value)


def _summary(kind: str, value: Column) -> Column:
    """The aggregate over a chunk's rows, which arrive in no particular order."""
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), F.col("_pos")))
    return getattr(F, kind)(value)


def _windowed(spec: Running, w) -> Column:
    frame = w.rowsBetween(Window.unboundedPreceding, -1 if spec.exclusive else Window.currentRow)
    value = _aggregate(spec.kind, spec.value).over(frame)
    return F.coalesce(value, F.lit(0)) if spec.kind == "sum" else value


def split_hot(
    df: DataFrame, keys: Sequence[str], max_rows: int = MAX_ROWS_PER_KEY
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of keys above ``max_rows`` or None when there is none)."""
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_rows).select(*keys)
    if hot.isEmpty():
        return df, None
    hot = small_side(cut_lineage(hot))
    return join_keys(df, hot, keys, "left_anti"), join_keys(df, hot, keys, "left_semi")


def per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], scan, max_rows: int = MAX_ROWS_PER_KEY):
    """Apply ``scan(OrderedRows) -> DataFrame`` with one window per key, chunked for hot keys."""
    cold, hot = split_hot(df, keys, max_rows)
    out = scan(OrderedRows.of(cold, keys, order))
    if hot is None:
        return out
    return out.unionByName(scan(OrderedRows.of(hot, keys, order, chunked=True)))


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    time: str,
    columns: Sequence[str],
    ties: Sequence[str] = (),
    max_rows: int = MAX_ROWS_PER_KEY,
) -> DataFrame:
    """As-of join: ``columns`` of the latest right row of the key that is not later than the left row; null without one.

    Both sides meet in one order, where the latest right row is a running value: a sorted merge of the two, with one
    shuffle, in chunks for a key of more than ``max_rows`` rows. Of right rows at one time the last by ``ties`` counts.
    A null key meets a null key; right rows without a time are never in force, left rows without one get nothing.
    """
    marks = right.filter(F.col(time).isNotNull()).select(
        *keys, time, F.struct(*columns).alias("_mark"), F.lit(0).alias("_side"), F.struct(F.lit(0), *ties).alias("_tie")
    )
    probes = left.withColumn("_side", F.lit(1))

    def scan(rows: OrderedRows) -> DataFrame:
        return rows.running(_hit=Running("last", F.col("_mark"))).result().filter("_side = 1")

    both = probes.unionByName(marks, allowMissingColumns=True)
    out = per_key(both, keys, [time, "_side", "_tie"], scan, max_rows)
    hit = F.when(F.col(time).isNotNull(), F.col("_hit"))
    return out.withColumns({c: hit[c] for c in columns}).select(*left.columns, *columns)


def hash_ordered_sum(
    df: DataFrame, keys: Sequence[str], hash_col: str, tie: Sequence[str], value: str, name: str
) -> DataFrame:
    """Sum of ``value`` over the rows of the key that come earlier in hash order, and ``<name>_total``.

    The leading hash digits are an order-preserving, evenly filled bucket, so no row
    order has to be fixed first.
    """
    rows = df.withColumn("_bucket", F.substring(hash_col, 1, 3))
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"),
        F.sum("_s").over(Window.partitionBy(*keys)).alias(f"{name}_total"),
    )
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(hash_col, *tie).rowsBetween(Window.unboundedPreceding, -1)
    )
    scanned = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (
        join_keys(scanned, sums, [*keys, "_bucket"])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_bucket", "_inside", "_before")
    )


def top_n(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    salt_by: Sequence[str],
    salts: int = 64,
) -> DataFrame:
    """First ``n`` rows of each key; salted first so that a large key is cut in parallel."""
    part = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        part.withColumn("_rn", F.row_number().over(first))
        .filter(F.col("_rn") <= n)
        .withColumn("_rn", F.row_number().over(final))
        .filter(F.col("_rn") <= n)
        .drop("_rn", "_salt")
    )


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One whole row per key, the first in ``order``; a map-side combined aggregate, no window."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def _running_sums(keys: Sequence[str], counts: Sequence[str]):
    """Adds ``cum_<count>``: sums within the key, over the rows of one sorted partition in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, {}
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            new = np.zeros(n, bool)
            for k in keys:
                codes = pd.factorize(batch.column(k).to_pandas())[0]
                new[1:] |= codes[1:] != codes[:-1]
            first = tuple(batch.column(k)[0].as_py() for k in keys)
            new[0] = first != last
            starts = np.flatnonzero(new)
            row = np.cumsum(new) - 1  # the key's place among those that begin here; -1: it goes on
            out = []
            for c in counts:
                sums = np.cumsum(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64))
                before = np.append(np.concatenate([[0], sums])[starts], -carry.get(c, 0))  # the last entry is row -1
                total = sums - before[row]
                carry[c] = int(total[-1])
                out.append(pa.array(total))
            last = tuple(batch.column(k)[n - 1].as_py() for k in keys)
            names = [*batch.schema.names, *[f"cum_{c}" for c in counts]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=names)

    return run


def cumulative_counts(df: DataFrame, keys: Sequence[str], value: str, counts: Sequence[str]) -> DataFrame:
    """Running sums of pre-aggregated ``counts`` in value order, as ``cum_<count>``, and their totals.

    A sorted chunk is scanned where it lies: only one summary row per key and chunk is shuffled again.
    """
    rows = ordered_chunks(df, keys, [value])
    sums = rows.groupBy(*keys, "_chunk").agg(*[F.sum(c).cast("long").alias(f"_t_{c}") for c in counts])
    whole = Window.partitionBy(*keys)
    carry = sums.select(
        *keys,
        "_chunk",
        *[F.coalesce(F.sum(f"_t_{c}").over(_carry_window(keys)), F.lit(0)).alias(f"_c_{c}") for c in counts],
        *[F.sum(f"_t_{c}").over(whole).alias(f"cum_{c}_total") for c in counts],
    )
    added = [StructField(f"cum_{c}", LongType()) for c in counts]
    local = rows.mapInArrow(_running_sums(keys, counts), StructType([*rows.schema, *added]))
    out = join_keys(local, small_side(cut_lineage(carry)), [*keys, "_chunk"])
    return out.withColumns({f"cum_{c}": F.col(f"cum_{c}") + F.col(f"_c_{c}") for c in counts}).drop(
        "_chunk", "_pos", *[f"_c_{c}" for c in counts]
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Interpolated quantiles per key, exact, without holding a key's values in one buffer.

    Equal values are counted before they are sorted, then the running count finds the rows
    on both sides of each rank.
    """
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = cumulative_counts(counts, keys, value, ["_n"]).withColumnRenamed("cum__n_total", "_total")
    aggs = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("_total") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        for side, rank in (("lo", lo), ("hi", hi)):
            inside = (F.col("cum__n") - F.col("_n") <= rank) & (rank < F.col("cum__n"))
            aggs.append(F.max(F.when(inside, F.col(value).cast("double"))).alias(f"_{name}_{side}"))
        aggs.append(F.max(pos - lo).alias(f"_{name}_frac"))
    out = ranked.groupBy(*keys).agg(*aggs)
    return out.select(
        *keys,
        *[
            (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_frac")).alias(n)
            for n in probs
        ],
    )
