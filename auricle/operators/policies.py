"""Trigger policies: validation, JSON payloads, profiles. One row per (profile, class)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import blank_to_null, messages
from ..params import AUDIO_MODES, POLICY_DEFAULTS, TAXONOMY
from .checks import DataContractError

# Policy fields and their types.
FIELDS = {
    "enabled": "boolean",
    "target_mode": "string",
    "confidence_threshold": "double",
    "confirm_windows": "int",
    "release_seconds": "double",
    "cooldown_seconds": "double",
    "high_priority": "boolean",
    "critical": "boolean",
    "quick_action_label": "string",
    "notify": "boolean",
}
POLICY_SCHEMA = "profile_name string, preferred_mode string, class_name string, " + ", ".join(
    f"{n} {t}" for n, t in FIELDS.items()
)

# JSON types accepted for each column type (null is accepted for text only).
JSON_TYPES = {
    "boolean": r"^BOOLEAN$",
    "string": r"^(STRING|VOID)$",
    "double": r"^(BIGINT|DOUBLE|DECIMAL.*)$",
    "int": r"^BIGINT$",
}

# The two example profiles, class -> overrides of the defaults.
ANC, PLAIN, SAFETY, _STANDBY = AUDIO_MODES
EXAMPLE_PROFILES = {
    "Commuting (example)": (
        ANC,
        {
            "Siren": {"target_mode": SAFETY, "confirm_windows": 1, "high_priority": True},
            "Vehicle_Horn": {"target_mode": PLAIN, "confirm_windows": 2},
            "Car_Engine": {"target_mode": ANC, "confirm_windows": 3},
            "Motorcycle": {"target_mode": ANC, "confirm_windows": 3},
            "Train": {"target_mode": ANC, "confirm_windows": 3},
        },
    ),
    "Home and Family (example)": (
        ANC,
        {
            "Baby_Crying": {"target_mode": PLAIN, "confirm_windows": 2, "high_priority": True},
            "Doorbell": {"target_mode": PLAIN, "confirm_windows": 1},
            "Knocking": {"target_mode": PLAIN, "confirm_windows": 2},
            "Dog_Bark": {"target_mode": PLAIN, "confirm_windows": 3},
            "Alarm": {"target_mode": SAFETY, "confirm_windows": 1, "high_priority": True},
            "Glass_Breaking": {
                "target_mode": SAFETY,
                "confirm_windows": 1,
                "high_priority": True,
                "critical": True,
                "quick_action_label": "Call emergency contact",
            },
            "Gunshot": {
                "target_mode": SAFETY,
                "confirm_windows": 1,
                "high_priority": True,
                "critical": True,
                "quick_action_label": "Call emergency contact",
            },
        },
    ),
}


def policy_problems(
    classes: Sequence[str] = TAXONOMY, modes: Sequence[str] = AUDIO_MODES, field: Callable[[str], Column] = F.col
) -> Column:
    """Names of the rules a policy breaks, in rule order; empty when it is valid.

    ``field`` gives the column of a field name, by default the row's own column.
    """

    def broken(rule: Column) -> Column:
        return ~F.coalesce(rule, F.lit(False))

    threshold, critical = field("confidence_threshold"), field("critical")
    label = F.coalesce(field("quick_action_label"), F.lit(""))
    return messages(
        (broken(field("class_name").isin(*classes)), "unknown_class"),
        (field("target_mode").isNotNull() & ~field("target_mode").isin(*modes), "unknown_target_mode"),
        (broken((threshold > 0) & (threshold <= 1)), "threshold_not_in_0_1"),
        (broken(field("confirm_windows") >= 1), "confirm_windows_below_1"),
        (broken(field("release_seconds") >= 0), "negative_release"),
        (broken(field("cooldown_seconds") >= 0), "negative_cooldown"),
        ((field("high_priority") | critical) & ~field("enabled"), "priority_of_disabled_entry"),
        (critical & (F.trim(label) == ""), "critical_without_action"),
        ((label != "") & ~critical, "action_without_critical"),
    )


def check_policies(policies: DataFrame, **kwargs) -> None:
    """Raise with every kind of problem of the table and the number of rows that have it."""
    problems = policies.select("class_name", F.explode(policy_problems(**kwargs)).alias("p"))
    bad = problems.groupBy("class_name", "p").agg(F.count(F.lit(1)).alias("n")).orderBy("class_name", "p").collect()
    if bad:
        raise DataContractError("; ".join(f"{r['class_name']}: {r['p']} ({r['n']})" for r in bad))


def policy_table(
    spark: SparkSession,
    profile: str,
    preferred_mode: str | None,
    entries: Mapping[str, Mapping[str, object]],
    classes: Sequence[str] = TAXONOMY,
) -> DataFrame:
    """A profile's table: the listed classes enabled with their overrides, all others disabled."""
    unknown = sorted(set(entries) - set(classes))
    if unknown:
        raise DataContractError(f"unknown classes {unknown}")
    rows = []
    for name in classes:
        own = {"enabled": True, **entries[name]} if name in entries else {}
        values = {**POLICY_DEFAULTS, **own}
        rows.append((profile, preferred_mode, name, *[values[f] for f in FIELDS]))
    return spark.createDataFrame(rows, POLICY_SCHEMA)


def build_profiles(
    class_modes: DataFrame, classes: Sequence[str] = TAXONOMY, defaults: Mapping[str, object] | None = None
) -> DataFrame:
    """Full policy rows from (profile_name, preferred_mode, class_name, target_mode) rows.

    Every profile gets every class; a class without a row is disabled. ``defaults`` are the other fields of
    the enabled classes (threshold, persistence, timers, flags). An unknown class or field is an error.
    """
    foreign = sorted(set(defaults or ()) - set(FIELDS) | set(defaults or ()) & {"enabled", "target_mode"})
    if foreign:
        raise DataContractError(f"unknown default fields {foreign}")
    unknown = class_modes.filter(~F.col("class_name").isin(*classes)).select("class_name").distinct().limit(5).collect()
    if unknown:
        raise DataContractError(f"unknown classes {sorted(r[0] for r in unknown)}")
    base = (
        class_modes.groupBy("profile_name")
        .agg(F.max("preferred_mode").alias("preferred_mode"))
        .withColumn("class_name", F.explode(F.array(*[F.lit(c) for c in classes])))
    )
    own = class_modes.select("profile_name", "class_name", "target_mode", F.lit(True).alias("enabled"))
    rows = base.join(own, ["profile_name", "class_name"], "left").withColumn(
        "enabled", F.coalesce("enabled", F.lit(False))
    )
    own_defaults = {**POLICY_DEFAULTS, **(defaults or {})}
    values = {
        n: F.when(F.col("enabled"), F.lit(own_defaults[n]).cast(FIELDS[n])).otherwise(F.lit(v).cast(FIELDS[n]))
        for n, v in POLICY_DEFAULTS.items()
        if n not in ("enabled", "target_mode")
    }
    return rows.withColumns(values).select("profile_name", "preferred_mode", "class_name", *FIELDS)


def enabled_list(policies: DataFrame, classes: Sequence[str] = TAXONOMY) -> DataFrame:
    """Enabled classes of each profile in taxonomy order."""
    seen = policies.groupBy("profile_name").agg(
        F.collect_set(F.when(F.col("enabled"), F.col("class_name"))).alias("_on")
    )
    ordered = F.filter(F.array(*[F.lit(c) for c in classes]), lambda c: F.array_contains("_on", c))
    return seen.select("profile_name", ordered.alias("enabled_classes"))


def parse_payloads(
    payloads: DataFrame, key: str, text: str, classes: Sequence[str] = TAXONOMY, modes: Sequence[str] = AUDIO_MODES
) -> tuple[DataFrame, DataFrame]:
    """(typed policy rows of accepted payloads, problems of rejected ones) of ``judge_payloads``, as rows."""
    judged = judge_payloads(payloads, key, text, classes, modes)
    rows = judged.select(key, F.explode("policies").alias("p")).select(key, "p.*")
    return rows, judged.select(key, F.explode("problems").alias("problem"))


def judge_payloads(
    payloads: DataFrame, key: str, text: str, classes: Sequence[str] = TAXONOMY, modes: Sequence[str] = AUDIO_MODES
) -> DataFrame:
    """One row per JSON text: its ``problems``, and without any its typed ``policies``, one for each class.

    A payload is rejected for any unknown class or field, wrong type or broken policy rule.
    A class that is absent or null is disabled; blank texts are null. Everything is decided
    inside the payload's own row, so nothing is shuffled.
    """

    def part(name: str) -> Column:
        return F.try_variant_get("_v", f"$.{name}", "variant")

    def members(value: Column, path: str) -> Column:
        return F.map_entries(F.try_variant_get(value, path, "map<string, variant>"))

    def is_object(kind: Column) -> Column:
        return F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False))

    doc = payloads.select(key, F.try_parse_json(text).alias("_v")).select(
        key,
        F.schema_of_variant("_v").alias("_kind"),
        F.schema_of_variant(part("profile_name")).alias("_k_name"),
        F.try_variant_get("_v", "$.profile_name", "string").alias("_name"),
        F.schema_of_variant(part("preferred_mode")).alias("_k_mode"),
        blank_to_null(F.trim(F.try_variant_get("_v", "$.preferred_mode", "string"))).alias("_mode"),
        F.schema_of_variant(part("policies")).alias("_k_policies"),
        F.transform(
            members(F.col("_v"), "$.policies"),
            lambda e: F.struct(
                e["key"].alias("class_name"),
                F.schema_of_variant(e["value"]).alias("kind"),
                F.transform(
                    members(e["value"], "$"),
                    lambda f: F.struct(f["key"].alias("name"), F.schema_of_variant(f["value"]).alias("type")),
                ).alias("fields"),
                *[_typed(e["value"], n, t).alias(n) for n, t in FIELDS.items()],
            ),
        ).alias("_entries"),
    )

    # An empty, false or zero name counts as none given.
    no_name = F.col("_k_name").isNull() | F.col("_name").isNull() | F.col("_name").isin("", "0", "false", "0.0")
    mode_kind = F.coalesce("_k_mode", F.lit("VOID"))
    # A missing "policies" is an empty one; an explicit null is not an object.
    policies_ok = F.col("_k_policies").isNull() | is_object(F.col("_k_policies"))
    top = messages(
        (~no_name & (F.col("_k_name") != "STRING"), "profile_name must be text"),
        (~mode_kind.rlike(JSON_TYPES["string"]), "preferred_mode must be text or null"),
        ((mode_kind == "STRING") & ~F.coalesce(F.col("_mode").isin(*modes), F.lit(True)), "unknown preferred_mode"),
        (~policies_ok, "policies must be an object"),
    )

    def entry_problems(e: Column) -> Column:
        name = e["class_name"]
        known = name.isin(*classes)
        own = messages(
            (~known, F.concat(F.lit("unknown class "), name)),
            (known & ~is_object(e["kind"]) & (e["kind"] != "VOID"), F.concat(name, F.lit(": policy must be an object"))),
        )
        fields = F.coalesce(F.array_compact(F.transform(e["fields"], lambda f: field_problem(name, f))), F.array())
        rules = F.transform(policy_problems(classes, modes, lambda n: e[n]), lambda p: F.concat(name, F.lit(": "), p))
        checked = F.when(known & is_object(e["kind"]), rules).otherwise(F.array())
        return F.concat(own, fields, checked)

    def field_problem(name: Column, f: Column) -> Column:
        fits = reduce(or_, [(f["name"] == n) & f["type"].rlike(JSON_TYPES[t]) for n, t in FIELDS.items()])
        return F.when(~f["name"].isin(*FIELDS), F.concat(name, F.lit(": unknown field "), f["name"])).when(
            ~fits, F.concat(name, F.lit(": wrong type of "), f["name"])
        )

    nested = F.flatten(F.transform(F.coalesce("_entries", F.array()), entry_problems))
    rows = doc.withColumn(
        "_problems",
        F.when(~is_object(F.col("_kind")), F.array(F.lit("payload is not an object"))).otherwise(F.concat(top, nested)),
    )
    listed = F.transform(
        F.array(*[F.lit(c) for c in classes]),
        lambda c: F.struct(
            c.alias("class_name"),
            F.get(F.filter("_entries", lambda e: (e["class_name"] == c) & is_object(e["kind"])), F.lit(0)).alias("own"),
        ),
    )
    def policy(c: Column) -> Column:
        return F.struct(
            F.when(no_name, "Custom").otherwise(F.col("_name")).alias("profile_name"),
            F.col("_mode").alias("preferred_mode"),
            c["class_name"].alias("class_name"),
            *[F.coalesce(c["own"][n], F.lit(POLICY_DEFAULTS[n]).cast(t)).alias(n) for n, t in FIELDS.items()],
        )

    policies = F.when(F.size("_problems") == 0, F.transform(listed, policy))
    return rows.select(key, F.col("_problems").alias("problems"), policies.alias("policies"))


def _typed(entry: Column, name: str, kind: str) -> Column:
    """A field of a policy object: its value, or the default where it is absent."""
    raw = F.try_variant_get(entry, f"$.{name}", kind)
    if kind == "string":
        return blank_to_null(F.trim(raw))
    return F.coalesce(raw, F.lit(POLICY_DEFAULTS[name]).cast(kind))
