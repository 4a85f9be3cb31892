"""Policy rules, payloads and profiles."""

import json

import pytest

from auricle.operators import policies as P
from auricle.operators import service
from auricle.operators.checks import DataContractError
from auricle.params import AUDIO_MODES, EARBUD_RESPONSES, TAXONOMY


def problems(spark, **values):
    name = values.pop("class_name", "Siren")
    df = P.policy_table(spark, "T", None, {"Siren": values}).filter("class_name = 'Siren'")
    from pyspark.sql import functions as F

    return df.withColumn("class_name", F.lit(name)).select(P.policy_problems()).first()[0]


@pytest.mark.parametrize(
    "values, want",
    [
        ({}, []),
        ({"class_name": "Cat"}, ["unknown_class"]),
        ({"target_mode": "Loud"}, ["unknown_target_mode"]),
        ({"confidence_threshold": 0.0}, ["threshold_not_in_0_1"]),
        ({"confidence_threshold": 1.0}, []),
        ({"confidence_threshold": 1.1}, ["threshold_not_in_0_1"]),
        ({"confidence_threshold": float("nan")}, ["threshold_not_in_0_1"]),
        ({"confirm_windows": 0}, ["confirm_windows_below_1"]),
        ({"release_seconds": -0.1}, ["negative_release"]),
        ({"cooldown_seconds": -1.0}, ["negative_cooldown"]),
        ({"enabled": False, "high_priority": True}, ["priority_of_disabled_entry"]),
        ({"critical": True}, ["critical_without_action"]),
        ({"critical": True, "quick_action_label": "  "}, ["critical_without_action"]),
        ({"quick_action_label": "Call"}, ["action_without_critical"]),
        ({"critical": True, "quick_action_label": "Call"}, []),
    ],
)
def test_rules(spark, values, want):
    assert problems(spark, **values) == want


def test_defaults_and_example_profiles(spark):
    rows = P.policy_table(spark, "T", None, {}).collect()
    assert [r["class_name"] for r in rows] == list(TAXONOMY) and not any(r["enabled"] for r in rows)
    r = rows[0]
    assert (r["confidence_threshold"], r["confirm_windows"], r["release_seconds"], r["cooldown_seconds"]) == (0.8, 3, 5.0, 5.0)
    assert r["notify"] and r["target_mode"] is None
    for name, (mode, entries) in P.EXAMPLE_PROFILES.items():
        table = P.policy_table(spark, name, mode, entries)
        P.check_policies(table)
        assert table.filter("enabled").count() == len(entries)
    with pytest.raises(DataContractError, match="Cat"):
        P.policy_table(spark, "T", None, {"Cat": {}})
    bad = P.policy_table(spark, "T", None, {"Siren": {"confirm_windows": 0}})
    with pytest.raises(DataContractError, match="Siren: confirm_windows_below_1"):
        P.check_policies(bad)


def test_class_mode_shorthand(spark):
    modes = spark.createDataFrame(
        [("p", AUDIO_MODES[0], "Train", AUDIO_MODES[1]), ("p", AUDIO_MODES[0], "Alarm", None)],
        "profile_name string, preferred_mode string, class_name string, target_mode string",
    )
    rows = P.build_profiles(modes)
    assert rows.count() == len(TAXONOMY) and rows.filter("enabled").count() == 2
    assert P.enabled_list(rows).first()["enabled_classes"] == ["Alarm", "Train"]
    own = P.build_profiles(modes, defaults={"confirm_windows": 7}).groupBy("enabled").agg({"confirm_windows": "max"})
    assert dict(map(tuple, own.collect())) == {True: 7, False: 3}
    with pytest.raises(DataContractError, match="colour"):
        P.build_profiles(modes, defaults={"colour": 1})
    with pytest.raises(DataContractError, match="Cat"):
        P.build_profiles(modes.selectExpr("profile_name", "preferred_mode", "'Cat' class_name", "target_mode"))


# payload -> problem (None: accepted)
PAYLOADS = [
    ('{"profile_name":"a","preferred_mode":"Transparency Mode","policies":{"Siren":{"enabled":true}}}', None),
    ('{"policies":{"Foo":{"enabled":true}}}', "unknown class Foo"),
    ('{"policies":{"Siren":{"enabled":1}}}', "Siren: wrong type of enabled"),
    ('{"policies":{"Siren":{"confirm_windows":1.5}}}', "Siren: wrong type of confirm_windows"),
    ('{"policies":{"Siren":{"confirm_windows":true}}}', "Siren: wrong type of confirm_windows"),
    ('{"policies":{"Siren":{"confidence_threshold":"0.5"}}}', "Siren: wrong type of confidence_threshold"),
    ("[1]", "payload is not an object"),
    ("not json", "payload is not an object"),
    (None, "payload is not an object"),
    ('{"policies":null}', "policies must be an object"),
    ('{"policies":[1]}', "policies must be an object"),
    ("{}", None),
    ('{"profile_name":5}', "profile_name must be text"),
    ('{"profile_name":0}', None),
    ('{"profile_name":"","preferred_mode":" "}', None),
    ('{"preferred_mode":"x"}', "unknown preferred_mode"),
    ('{"preferred_mode":4}', "preferred_mode must be text or null"),
    ('{"policies":{"Siren":{"bar":1}}}', "Siren: unknown field bar"),
    ('{"policies":{"Siren":{"confidence_threshold":1}}}', None),
    ('{"policies":{"Siren":{"confidence_threshold":2,"target_mode":null}}}', "Siren: threshold_not_in_0_1"),
    ('{"policies":{"Siren":7}}', "Siren: policy must be an object"),
    ('{"policies":{"Siren":null}}', None),
    ('{"policies":{"Siren":{"notify":null}}}', "Siren: wrong type of notify"),
]


def test_payloads(spark):
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(PAYLOADS)], "id int, js string")
    rows, rejects = P.parse_payloads(df, "id", "js")
    got = {}
    for r in rejects.collect():
        got.setdefault(r["id"], []).append(r["problem"])
    assert got == {i: [w] for i, (_, w) in enumerate(PAYLOADS) if w}
    accepted = {i for i, (_, w) in enumerate(PAYLOADS) if w is None}
    assert {r["id"] for r in rows.select("id").distinct().collect()} == accepted
    assert rows.count() == len(accepted) * len(TAXONOMY)
    first = rows.filter("id = 0 AND class_name = 'Siren'").first()
    assert first["enabled"] and first["profile_name"] == "a" and first["confidence_threshold"] == 0.8
    names = {r["id"]: r["profile_name"] for r in rows.collect()}
    assert names[11] == names[13] == names[14] == "Custom"


def test_full_payload_round_trip(spark):
    entry = {
        "enabled": True, "target_mode": AUDIO_MODES[2], "confidence_threshold": 0.5, "confirm_windows": 1, "release_seconds": 2.0,
        "cooldown_seconds": 0.0, "high_priority": True, "critical": True, "quick_action_label": " Call ", "notify": False,
    }
    df = spark.createDataFrame([(1, json.dumps({"policies": {"Alarm": entry}}))], "id int, js string")
    rows, rejects = P.parse_payloads(df, "id", "js")
    row = rows.filter("class_name = 'Alarm'").first().asDict()
    assert rejects.isEmpty() and {k: row[k] for k in entry} == {**entry, "quick_action_label": "Call"}


def test_responses_cover_the_taxonomy(spark):
    tax = spark.createDataFrame([(c,) for c in TAXONOMY], "class_name string")
    table = spark.createDataFrame(list(EARBUD_RESPONSES.items()), "class_name string, response string")
    assert service.response_coverage(table, tax).isEmpty()
    gaps = service.response_coverage(table.filter("class_name <> 'Train'"), tax.filter("class_name <> 'Alarm'"))
    assert sorted(map(tuple, gaps.collect())) == [("Alarm", "unknown"), ("Train", "missing")]


def test_catalog_refuses_duplicates(spark):
    splits = spark.createDataFrame([("a", "val"), ("a", "val")], "clip_id string, split string")
    ledger = spark.createDataFrame([("a", "kept", "Siren")], "clip_id string, status string, project_class string")
    with pytest.raises(DataContractError, match="validation"):
        service.catalog_allowlist(splits, ledger, "clip_id", "project_class", TAXONOMY, 3)
