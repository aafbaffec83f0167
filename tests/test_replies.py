"""Fences, invalid replies, schema enforcement, attempts, prompts."""

import json

from pyspark.sql import functions as F

from specmill.operators.replies import (
    RETRY_NOTE,
    is_quota_error,
    prompt,
    prompt_head,
    reply_error,
    resolved,
    with_raw,
)


def raws(spark, rules, replies):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string")
    rows = with_raw(df, rules).orderBy("i").collect()
    return [None if r["raw"] is None else r["raw"].asDict(recursive=True) for r in rows]


def test_reply_becomes_exactly_the_rule_fields(spark, rules, good):
    good["colour"] = "blue"
    del good["weight"]
    good["part_number"] = 2405
    good["response_time"] = 3000
    good["measuring_range"] = True
    good["ip_rating"] = 24.0
    raw = raws(spark, rules, [json.dumps(good)])[0]
    assert list(raw) == rules.names
    assert raw["weight"] is None
    assert raw["part_number"] == "2405"
    assert raw["measuring_range"] == "True"
    assert raw["ip_rating"] == "24.0"
    assert raw["response_time"] == {"value": "3000", "unit": None, "kind": "BIGINT"}
    assert raw["supply_voltage_min"] == {"value": "9", "unit": "V DC", "kind": "BIGINT"}


def test_fences(spark, rules, good):
    text = json.dumps(good)
    forms = [
        f"```json\n{text}\n```",
        f"```\n{text}\n```",
        f"  ```json{text}``` \n",
        f"　{text} ",
        f"```JSON\n{text}\n```",
        f"```json\n{text}",
    ]
    found = raws(spark, rules, forms)
    assert [r is not None for r in found] == [True, True, True, False, False, False] or [
        r is not None for r in found
    ] == [True, True, True, True, False, False]


def test_texts_that_are_no_single_object(spark, rules, good):
    text = json.dumps(good)
    bad = [
        "nope", "", " ", "[1, 2, 3]", "null", '"text"', "12", "1.5", "true", text + " x", text + text,
        text + "," + text, text + "] x", "{'a': 1}", text[:-1], text + " x}", None,
    ]
    assert raws(spark, rules, bad) == [None] * len(bad)
    df = spark.createDataFrame([(i, r) for i, r in enumerate(bad)], "i int, reply string")
    errors = [r["e"] for r in df.orderBy("i").select(reply_error(F.col("reply")).alias("e")).collect()]
    kinds = [e.rsplit(" ", 1)[-1] if "not an object" in e else "" for e in errors]
    assert kinds[3:9] == ["list", "NoneType", "str", "int", "float", "bool"]
    assert errors[0] == errors[1] == "reply is not valid JSON"


def test_odd_but_valid_objects(spark, rules):
    found = raws(
        spark, rules,
        ["{}", '{"weight": NaN}', '{"weight": 1, "weight": 2}', '{"weight": 1' + "0" * 400 + "}",
         '{"weight": {"value": "true", "unit": 5}}', '{"weight": {"value": true}}', '{"weight": null}'],
    )
    assert found[0] == dict.fromkeys(rules.names)
    assert found[1]["weight"]["value"] == "NaN"
    assert found[2]["weight"]["value"] == "2"
    assert found[3]["weight"]["value"] == "Infinity"
    assert found[4]["weight"] == {"value": "true", "unit": "5", "kind": "STRING"}
    assert found[5]["weight"] == {"value": "true", "unit": None, "kind": "BOOLEAN"}
    assert found[6]["weight"] is None


def test_first_usable_attempt_wins_and_errors_end_a_document(spark, rules):
    ok = '{"part_number": "%s"}'
    rows = [
        ("a", 1, "nope", None), ("a", 2, ok % "A2", None), ("a", 3, ok % "A3", None),
        ("b", 1, "nope", None), ("b", 2, "[1]", None), ("b", 3, "still", None), ("b", 4, ok % "B4", None),
        ("c", 1, "nope", None), ("c", 2, None, "RuntimeError: 429 RESOURCE_EXHAUSTED"), ("c", 3, ok % "C3", None),
        ("d", 1, ok % "D1", None), ("d", 2, None, "RuntimeError: late"),
        ("e", 1, None, "TimeoutError: slow"),
        ("f", 1, "x", None), ("f", 2, "y", None), ("f", 3, "[2]", None),
    ]
    df = spark.createDataFrame(rows, "source_hash string, attempt int, reply string, error string")
    got = {r["source_hash"]: r for r in resolved(df, rules).collect()}
    assert got["a"]["raw"]["part_number"] == "A2" and got["a"]["attempt"] == 2
    assert got["b"]["failure"] == "No usable reply after 3 attempt(s): reply is not valid JSON"
    assert got["c"]["quota"] and "quota" in got["c"]["failure"] and got["c"]["raw"] is None
    assert got["d"]["raw"]["part_number"] == "D1" and got["d"]["failure"] is None
    assert got["e"]["failure"] == "TimeoutError: slow" and not got["e"]["quota"]
    assert got["f"]["failure"].endswith("not an object: list")


def test_quota_classifier(spark):
    df = spark.createDataFrame(
        [("x 429 y", None), ("RESOURCE_EXHAUSTED", None), ("other", 429), ("other", 500), (None, None)],
        "error string, code int",
    )
    got = [r[0] for r in df.select(is_quota_error(F.col("error"), F.col("code"))).collect()]
    assert got == [True, True, True, False, False]


def test_prompt_fences_the_text_and_adds_the_note_once(spark, rules):
    df = spark.createDataFrame([('Output """4-20 mA""" end',)], "t string")
    first, again = df.select(prompt(F.col("t"), rules), prompt(F.col("t"), rules, retry=True)).first()
    assert all(f". {name}: " in first for name in rules.names)
    assert "Output '''4-20 mA''' end" in first and first.count('"""') == 2
    assert RETRY_NOTE not in first and again == first + RETRY_NOTE
    assert "usually in V" in prompt_head(rules)
