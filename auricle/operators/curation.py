"""Curation: label mapping, multi-label matching, leakage guards, sampling, manifests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import blank_to_null, messages, seeded_key
from ..session import cut_lineage
from .ordered import first_row, small_side, top_n


def label_map_filter(df: DataFrame, mapping: DataFrame, on: str) -> DataFrame:
    """Keep the rows whose label is mapped and attach the mapping's columns."""
    return df.join(small_side(mapping), on)


def match_any(labels: Column, wanted: Sequence[str]) -> Column:
    return F.arrays_overlap(labels, F.array(*[F.lit(w) for w in wanted]))


def match_all(labels: Column, wanted: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.array_contains(labels, w) for w in wanted])


def match_all_or_fallback(
    df: DataFrame, labels: Column, wanted: Sequence[str], fallback: str, min_hits: int
) -> DataFrame:
    """Rows with all labels; if fewer than ``min_hits`` rows have them, rows with ``fallback``."""
    flagged = df.withColumns(
        {"_all": match_all(labels, wanted), "_one": F.array_contains(labels, fallback)}
    )
    hits = flagged.agg(F.count_if("_all").alias("n")).scalar()
    chosen = F.when(hits < min_hits, F.col("_one")).otherwise(F.col("_all"))
    return flagged.filter(chosen).drop("_all", "_one")


def exclude_colabels(df: DataFrame, labels: Column, banned: Sequence[str]) -> DataFrame:
    return df.filter(~match_any(labels, banned))


def source_whitelist(df: DataFrame, rules: Sequence[Column]) -> DataFrame:
    """Rows accepted by at least one per-source rule."""
    return df.filter(reduce(lambda a, b: a | b, rules))


def leakage_guard(df: DataFrame, id_col: str, used: Sequence[DataFrame]) -> DataFrame:
    """Drop rows whose source id is already used; each used frame has one id column."""
    ids = reduce(DataFrame.union, [u.toDF(id_col) for u in used])
    return df.join(ids.filter(F.col(id_col).isNotNull()).distinct(), id_col, "left_anti")


@dataclass(frozen=True)
class Rule:
    """One class of a priority list: rows matching ``predicate``, at most ``cap`` of them."""

    name: str
    predicate: Column
    cap: int | None = None


def priority_assign(
    df: DataFrame, id_col: str, rules: Sequence[Rule], seed: int, name: str = "project_class"
) -> DataFrame:
    """Give each row to the first rule that takes it; rows cut by a cap stay available.

    A capped rule draws its rows in seeded order. Only the order key of its last accepted
    row is needed to mark them, so the rules stay one chain of column expressions. Those keys are found on the few
    rows that a cap can reach, which one scan of the table brings together. Rows that share an id count once.
    """
    keyed = df.withColumn("_key", seeded_key(seed, id_col))
    id_type = df.schema[id_col].dataType

    def chain(rows: DataFrame, wants: Sequence[Column], ends: Mapping[int, tuple | None]) -> DataFrame:
        """``rows`` with the class that the rules up to the last one in ``ends`` give."""
        out = rows.withColumn(name, F.lit(None).cast("string"))
        for i, rule in enumerate(rules[: len(ends)]):
            taken = F.col(name).isNull() & wants[i]
            if ends[i] is not None:
                key, last = ends[i]
                taken &= F.struct("_key", id_col) <= F.struct(F.lit(key), F.lit(last).cast(id_type))
            out = out.withColumn(name, F.when(taken, F.lit(rule.name)).otherwise(F.col(name)))
        return out

    few = _within_reach(keyed, id_col, rules)
    flags = [F.col("_p")[i] for i in range(len(rules))]
    ends: dict[int, tuple | None] = {}
    for i, rule in enumerate(rules):
        end = None
        if rule.cap is not None:
            free = chain(few, flags, ends).filter(F.col(name).isNull() & flags[i])
            drawn = top_n(free.select("_key", id_col), [], [F.col("_key"), F.col(id_col)], rule.cap, [id_col])
            last = drawn.agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("_key", id_col)).alias("last")).first()
            if last["n"] == rule.cap:
                end = tuple(last["last"])
        ends[i] = end
    wants = [F.coalesce(rule.predicate, F.lit(False)) for rule in rules]
    return chain(keyed, wants, ends).filter(F.col(name).isNotNull()).drop("_key")


def _within_reach(keyed: DataFrame, id_col: str, rules: Sequence[Rule]) -> DataFrame | None:
    """``_key``, id and ``_p`` (what each rule says) of the rows that a capped rule may draw.

    A capped rule draws from rows that no rule without a cap took before it. Of these in seeded order, caps before it
    hold as many as they say at most, so its own rows are among the first of all caps together.
    """
    capped = [i for i, rule in enumerate(rules) if rule.cap is not None]
    if not capped:
        return None
    marked = keyed.select("_key", id_col, F.array(*[F.coalesce(r.predicate, F.lit(False)) for r in rules]).alias("_p"))

    def within(i: int) -> Column:
        before = [F.col("_p")[j] for j in range(i) if rules[j].cap is None]
        return reduce(lambda a, b: a & ~b, before, F.col("_p")[i])

    of = F.array_compact(F.array(*[F.when(within(i), F.lit(i)) for i in capped]))
    rows = marked.withColumn("_rule", F.explode(of))
    first = top_n(rows, ["_rule"], [F.col("_key"), F.col(id_col)], sum(rules[i].cap for i in capped), [id_col])
    return cut_lineage(first.drop("_rule").distinct())


def capped_sample(df: DataFrame, keys: Sequence[str], id_col: str, cap: int, seed: int) -> DataFrame:
    """At most ``cap`` rows per key, drawn in seeded order."""
    keyed = df.withColumn("_key", seeded_key(seed, id_col))
    return top_n(keyed, keys, [F.col("_key"), F.col(id_col)], cap, [id_col]).drop("_key")


def default_fill(df: DataFrame, dataset_col: str, defaults: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Fill null or blank columns with the defaults of the row's dataset."""
    cols = sorted({c for d in defaults.values() for c in d})
    fills = {}
    for c in cols:
        default = F.lit(None).cast("string")
        for dataset, values in defaults.items():
            if c in values:
                default = F.when(F.col(dataset_col) == dataset, F.lit(values[c])).otherwise(default)
        fills[c] = F.coalesce(blank_to_null(c), default, F.col(c))
    return df.withColumns(fills)


def derive_duration(duration: str, start: str, end: str) -> Column:
    """The duration, or round(end - start, 4) where it is missing."""
    return F.coalesce(
        blank_to_null(duration).cast("double"),
        F.round(F.col(end).cast("double") - F.col(start).cast("double"), 4),
    )


def dedupe_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_row(df, keys, order)


def incremental_merge(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Append a batch; a row already present wins over the new one."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(
        new.withColumn("_batch", F.lit(1)), allowMissingColumns=True
    )
    return first_row(both, keys, ["_batch", *order]).drop("_batch")


def validation_status(
    invalid: Sequence[tuple[Column, str | Column]], warnings: Sequence[tuple[Column, str | Column]]
) -> dict[str, Column]:
    """Status and notes: the first failed hard rule makes a row invalid, else notes make a warning."""
    hard = messages(*invalid)
    soft = messages(*warnings)
    return {
        "validation_status": F.when(F.size(hard) > 0, "invalid")
        .when(F.size(soft) > 0, "warning")
        .otherwise("ok"),
        "v_notes": F.when(F.size(hard) > 0, F.element_at(hard, 1)).otherwise(F.array_join(soft, ";")),
    }


def keyword_classify(text: str, keywords: Sequence[tuple[str, str]]) -> Column:
    """Class of the first keyword contained in the lower-cased text, null when none is."""
    low = F.lower(F.col(text))
    return F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in keywords])


def label_vocabulary_counts(df: DataFrame, labels: Column, targets: DataFrame) -> DataFrame:
    """Occurrences of each target label in exploded label lists, zero included."""
    counts = df.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return targets.join(counts, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def crosstab(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    wide = df.groupBy(row).pivot(col, list(values)).count()
    return wide.na.fill(0, subset=list(values))


def manifest_status_rollup(df: DataFrame, class_col: str, status_col: str) -> DataFrame:
    """Rows per class and status, and the totals per status (class ALL)."""
    return (
        df.groupingSets([[class_col, status_col], [status_col]], class_col, status_col)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn(class_col, F.coalesce(class_col, F.lit("ALL")))
    )


def union_manifests(
    parts: Sequence[DataFrame],
    renames: Mapping[str, str],
    required: Sequence[str],
    optional: Sequence[str],
) -> DataFrame:
    """Union of per-source manifests: legacy names renamed, missing optional columns added as null."""
    frames = []
    for part in parts:
        df = part.withColumnsRenamed({k: v for k, v in renames.items() if k in part.columns})
        missing = [c for c in required if c not in df.columns]
        if missing:
            raise ValueError(f"missing required columns {missing}")
        added = {c: F.lit(None).cast("string") for c in optional if c not in df.columns}
        frames.append(df.withColumns(added).select(*required, *optional))
    return reduce(DataFrame.unionByName, frames)
