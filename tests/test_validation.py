"""Each test changes a good reply and looks at values and problem codes."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from specmill.functions.numbers import parse_finite, round3, shown
from specmill.operators.replies import with_raw
from specmill.operators.validation import as_records, of_severity, validated
from specmill.sources.rules import check_units, load_rules, parse_rules
from tests.conftest import number


def check(spark, rules, *replies):
    df = spark.createDataFrame(
        [(i, json.dumps(r) if isinstance(r, dict) else r) for i, r in enumerate(replies)], "seq int, reply string"
    )
    return validated(with_raw(df, rules), rules).orderBy("seq").collect()


def codes(row, field=None):
    return [p["code"] for p in row["problems"] if field in (None, p["field"])]


def test_good_reply_has_no_problem(spark, rules, good):
    row = check(spark, rules, good)[0]
    assert row["status"] == "ok" and row["problems"] == []
    assert row["data"]["operating_temp_min"] == -15 and row["data"]["weight"] == 310


def test_missing_values(spark, rules, good):
    good.update(operating_temp_min=None, weight=None, measuring_range="  ", sensor_type=" ")
    good["response_time"] = number(" ", "ms")
    del good["part_number"]
    row = check(spark, rules, good)[0]
    assert row["status"] == "error"
    assert [(p["field"], p["code"]) for p in row["problems"]] == [
        ("part_number", "missing"), ("sensor_type", "missing"), ("operating_temp_min", "missing"),
    ]
    assert row["data"]["weight"] is None and row["data"]["measuring_range"] is None


def test_units(spark, rules, good):
    good.update(
        operating_temp_min=number(-13, "°F"), operating_temp_max=number(353.15, "K"),
        weight=number(0.12, "kg"), response_time=number(3, "s"), supply_voltage_min=number(18000, "m V"),
    )
    row = check(spark, rules, good)[0]
    assert row["problems"] == []
    data = row["data"]
    assert (data["operating_temp_min"], data["operating_temp_max"]) == (-25, 80)
    assert (data["weight"], data["response_time"], data["supply_voltage_min"]) == (120, 3000, 18)


def test_unknown_and_missing_units(spark, rules, good):
    good.update(weight=number(5, "stone"), response_time=number(30000, None), supply_voltage_min=number(9, ""))
    row = check(spark, rules, good)[0]
    assert codes(row, "weight") == ["unknown_unit"] and row["data"]["weight"] is None
    assert codes(row, "response_time") == ["missing_unit", "out_of_range"]
    assert row["data"]["response_time"] == 30000
    assert codes(row, "supply_voltage_min") == ["unknown_unit"]
    assert row["status"] == "error"


def test_unusable_numbers(spark, rules, good):
    bad = ["about 120", float("nan"), float("inf"), 10**400, "1e999", "12d", "0x10", "1,5", [1], {"a": 1}, "1__0"]
    replies = [{**good, "weight": number(v, "g")} for v in bad] + [{**good, "weight": number(1e306, "kg")}]
    for value, row in zip(bad + ["after conversion"], check(spark, rules, *replies)):
        assert codes(row) == ["not_a_number"], value
        assert row["data"]["weight"] is None
        assert len(row["problems"][0]["message"]) < 80
    long = json.dumps({**good, "weight": number("?", "g")}).replace('"?"', "9" * 1001)
    row = check(spark, rules, long)[0]
    assert codes(row) == ["not_a_number"] and row["data"]["supply_voltage_min"] == 9
    row = check(spark, rules, long.replace("9" * 1001, "0." + "3" * 2000))[0]
    assert row["problems"] == [] and row["data"]["weight"] == 0.333
    fine = [("1_000", 1000), (" 12 ", 12), ("１２", 12), (True, 1), (".5", 0.5), ("1e3", 1000), ("+7", 7)]
    rows = check(spark, rules, *[{**good, "weight": number(v, "g")} for v, _ in fine])
    for (value, expected), row in zip(fine, rows):
        assert row["data"]["weight"] == expected and row["problems"] == [], value


def test_range_bounds_and_message(spark, rules, good):
    rows = check(
        spark, rules,
        {**good, "operating_temp_min": number(-60, "C"), "supply_voltage_max": number(60, "V")},
        {**good, "operating_temp_min": number(-60.001, "C"), "supply_voltage_max": number(60.001, "V")},
        {**good, "operating_temp_max": number(250, "C")},
        {**good, "supply_voltage_max": number(60.0004, "V")},
    )
    assert rows[0]["problems"] == [] and rows[3]["problems"] == []
    assert codes(rows[1]) == ["out_of_range"] * 2
    assert rows[2]["data"]["operating_temp_max"] == 250 and rows[2]["status"] == "warning"
    assert rows[2]["problems"][0]["message"] == "250 C is outside the expected 0.0 to 200.0"


def test_enum_and_pattern(spark, rules, good):
    row = check(
        spark, rules, {**good, "sensor_type": " Temperature", "output_signal": "4...20 mA", "ip_rating": "IP6"}
    )[0]
    assert row["data"]["sensor_type"] == "temperature"
    assert row["data"]["output_signal"] == "4...20 mA"
    assert codes(row) == ["invalid_enum", "pattern_mismatch"] and row["status"] == "warning"
    ratings = ["IP69K", "IP 67", "IP65; IP67", "IP67, IP66", "IP67\n"]
    for printed, row in zip(ratings, check(spark, rules, *[{**good, "ip_rating": r} for r in ratings])):
        assert row["problems"] == [], printed
    assert codes(check(spark, rules, {**good, "ip_rating": "IP67\nx"})[0]) == ["pattern_mismatch"]


def test_severity_slices_and_records(spark, rules, good):
    df = spark.createDataFrame(
        [(1, "f/a.pdf", "h", json.dumps({**good, "weight": 5, "part_number": None}))],
        "seq long, source_file string, source_hash string, reply string",
    )
    checked = validated(with_raw(df, rules), rules)
    errors, warnings = checked.select(
        of_severity(F.col("problems"), "error"), of_severity(F.col("problems"), "warning")
    ).first()
    assert [p["field"] for p in errors] == ["part_number"] and [p["field"] for p in warnings] == ["weight"]
    record = as_records(checked, rules).first()
    assert record["manufacturer"] == "Nordlicht Messtechnik AG" and record["part_number"] is None
    assert record["component_type"] == "sensor" and record["extracted_at"] is not None


def test_rounding_equals_exact_binary_rounding(spark):
    rng = random.Random(7)
    values = [rng.randrange(-10**8, 10**8) / 10**4 for _ in range(4000)]
    values += [(rng.randrange(-10**6, 10**6) * 10 + 5) / 10**4 for _ in range(8000)]
    values += [rng.randrange(-10**6, 10**6) / 16 for _ in range(2000)]
    values += [rng.uniform(-1, 1) * 10 ** rng.randrange(-6, 12) for _ in range(4000)]
    values += [0.0, -0.0, 0.0005, -0.0005, 0.0015, 2.5, 1e300, -1e300]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(round3(F.col("v"))).collect()]
    wrong = [(v, g, round(v, 3)) for v, g in zip(values, got) if g != round(v, 3)]
    assert wrong == []
    assert struct.pack("d", got[values.index(0.0)]) == struct.pack("d", 0.0)


def test_number_display_and_grammar(spark):
    numbers = [250.0, -60.001, 0.0, 1200.5, 12345678.25, 0.001, 1e20]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(numbers)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(shown(F.col("v"))).collect()]
    assert got == [str(int(v)) if v.is_integer() else str(v) for v in numbers]
    texts = ["1", "1.", ".1", ".", "1e", "1e5", "1_0", "_1", "1_", "--1", "inf", "nan", "١٢", "1 2", "٣.٥"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(parse_finite(F.col("v"))).collect()]

    def expected(text):
        try:
            value = float(text)
        except ValueError:
            return None
        return value if abs(value) < float("inf") else None

    assert got == [expected(t) for t in texts]


def test_rule_files_are_checked(tmp_path):
    field = {"name": "a", "type": "number"}
    bad = [
        {"fields": [field]}, {"component_type": "x"}, {"component_type": "x", "fields": []},
        {"component_type": "x", "fields": [{"type": "string"}]},
        {"component_type": "x", "fields": [{"name": "a", "type": "date"}]},
        {"component_type": "x", "fields": [{"name": "a", "type": "enum"}]},
        {"component_type": "x", "fields": [{**field, "range": [2, 1]}]},
        {"component_type": "x", "fields": [{**field, "range": [1]}]},
        {"component_type": "x", "fields": [field, field]},
    ]
    for spec in bad:
        with pytest.raises(ValueError):
            parse_rules(spec)
    with pytest.raises(ValueError):
        check_units(parse_rules({"component_type": "x", "fields": [{**field, "unit": "bar"}]}))
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"component_type": "x", "fields": [{**field, "range": [1, 2]}]}))
    assert load_rules(path).rule("a").low == 1.0 and load_rules(path).rule("b") is None
