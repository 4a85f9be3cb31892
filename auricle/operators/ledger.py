"""Provenance ledger: one row per manifest clip, kept or excluded, with every parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import messages
from ..params import MIN_SECONDS, PRESETS, SAMPLE_RATE, SILENT_DBFS, TRUNCATE_SECONDS
from .checks import DataContractError, duplicate_keys, pairing_report, require_zero
from .ordered import small_side

# Source-id patterns of the two grouped collections.
SUBJECT_UUID = r"^donateacry:([0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12})"
SESSION_PREFIX = r"^recanvo:([0-9]{6}_[0-9]{4})"

# Ledger columns in output order.
LEDGER_COLUMNS = (
    "clip_id source_dataset source_file source_id group_key original_label project_class class_id license "
    "source_url local_path duration_s sample_rate channels rms_db peak sha256 health_flags status reason "
    "truncated processed_duration_s resample_sr mono window_samples window_step_samples pad_fraction"
).split()


def check_alignment(manifest: DataFrame, health: DataFrame, key: str) -> None:
    """Manifest and health must match one to one."""
    require_zero(pairing_report(manifest, health, [key]), "manifest and file health are not aligned")


def exclusion_reason(flags: str) -> Column:
    """Empty for a kept clip, else the failed rules joined by ';'."""
    f = F.col(flags)
    return F.array_join(
        messages(
            (F.array_contains(f, "extreme_short"), f"extreme_short(<{MIN_SECONDS:g}s)"),
            (F.array_contains(f, "silent"), f"silent(RMS<={SILENT_DBFS:g}dBFS)"),
        ),
        ";",
    )


def status_of(reason: str) -> Column:
    return F.when(F.col(reason) == "", "kept").otherwise("excluded")


def class_id_lookup(df: DataFrame, taxonomy: DataFrame, cls: str, strict: bool = True) -> DataFrame:
    """Attach ``class_id``; an unknown class name is an error unless ``strict`` is off (then null)."""
    out = df.join(small_side(taxonomy.withColumnRenamed("class_name", cls)), cls, "left")
    if strict:
        unknown = [r[0] for r in out.filter(F.col("class_id").isNull()).select(cls).distinct().limit(5).collect()]
        if unknown:
            raise DataContractError(f"classes not in the taxonomy: {sorted(map(str, unknown))}")
    return out


def clip_key(dataset: str, file: str) -> Column:
    return F.concat_ws("/", F.col(dataset), F.col(file))


def check_unique(df: DataFrame, key: str) -> None:
    dupes = [r[0] for r in duplicate_keys(df, [key]).select(key).limit(5).collect()]
    if dupes:
        raise DataContractError(f"{key} is not unique: {sorted(map(str, dupes))}")


def group_key(dataset: str, source_id: str) -> Column:
    """Leakage unit of a clip; null when the id does not have the form its origin promises."""
    sid = F.col(source_id).cast("string")
    subject = F.regexp_extract(sid, SUBJECT_UUID, 1)
    session = F.regexp_extract(sid, SESSION_PREFIX, 1)
    return (
        F.when(
            F.startswith(sid, F.lit("donateacry:")),
            F.when(subject != "", F.concat(F.lit("babycry/donateacry:"), F.lower(subject))),
        )
        .when(
            F.startswith(sid, F.lit("recanvo:")),
            F.when(session != "", F.concat(F.lit("babycry/recanvo:"), session)),
        )
        .when((sid != "") & ~sid.isin("nan", "None"), F.concat(F.lower(F.col(dataset)), F.lit("/"), sid))
    )


def truncate_duration(duration: str, kept: Column, limit: float = TRUNCATE_SECONDS) -> dict[str, Column]:
    d = F.col(duration)
    return {
        "truncated": F.coalesce(d > limit, F.lit(False)) & kept,
        "processed_duration_s": F.when(kept, F.least(d, F.lit(limit))),
    }


def clip_ledger(manifest: DataFrame, health: DataFrame, taxonomy: DataFrame, key: str, preset: str = "A") -> DataFrame:
    """Join manifest and health on ``key`` and derive the ledger columns.

    Rules are checked before the result is returned: alignment, known classes, unique
    clip ids and well-formed source ids.
    """
    check_alignment(manifest, health, key)
    window, step, *_ = PRESETS[preset]
    kept = F.col("status") == "kept"

    def when_kept(value) -> Column:
        return F.when(kept, F.lit(value))

    rows = (
        manifest.join(health, key)
        .withColumns(
            {
                "clip_id": clip_key("source_dataset", "source_file"),
                "group_key": group_key("source_dataset", "source_id"),
                "reason": exclusion_reason("flags"),
                "health_flags": F.array_join("flags", ","),
            }
        )
        .withColumn("status", status_of("reason"))
    )
    rows = class_id_lookup(rows, taxonomy, "project_class")
    check_unique(rows, "clip_id")
    bad = rows.filter(F.col("group_key").isNull()).limit(1).collect()
    if bad:
        raise DataContractError(f"malformed source_id: {bad[0]['source_id']!r}")
    return rows.withColumns(
        {
            **truncate_duration("duration_s", kept),
            "resample_sr": when_kept(float(SAMPLE_RATE)),
            "mono": when_kept(True),
            "window_samples": when_kept(float(window)),
            "window_step_samples": when_kept(float(step)),
            "pad_fraction": when_kept(0.0),
        }
    ).select(*LEDGER_COLUMNS)


def ledger_reason_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))
