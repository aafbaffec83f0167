"""Validation of raw values: cleaned columns, problems and a status, in one narrow pass.

The number fields form one array that passes through a chain of transforms, so the plan
and its generated code do not grow with the number of fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specmill.functions.numbers import as_double, finite, round3, shown
from specmill.functions.once import evaluated_once
from specmill.functions.text import shortened, single_quoted, strip
from specmill.functions.units import CONVERSION, conversion, convert, normalise_unit, unit_table
from specmill.sources.rules import PROBLEM, FieldRule, RuleSet, check_units

ERROR, WARNING, OK = "error", "warning", "ok"


MISSING_TEXT = "Required field not found"


def problem(field: Column | str, code: str, severity: str, message: Column | str) -> Column:
    return F.struct(
        (F.lit(field) if isinstance(field, str) else field).alias("field"),
        F.lit(code).alias("code"),
        F.lit(severity).alias("severity"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"),
    )


def _number_steps(rows: DataFrame, numbers: list[FieldRule], raw: str) -> DataFrame:
    """Adds ``_result`` (array of numbers) and ``_found`` (array of problem arrays).

    Every step is one lambda over plain values of all number fields; what differs between the
    fields is looked up by position in literal arrays.
    """

    def entries(member: str) -> Column:
        return F.array(*[F.col(raw)[r.name][member] for r in numbers])

    def fixed(values, kind: str) -> Column:
        return F.array(*[F.lit(v).cast(kind) for v in values])

    how = [
        conversion(normalise_unit(F.col(raw)[r.name]["unit"]), unit_table(r.unit)) if r.unit
        else F.lit(None).cast(CONVERSION)
        for r in numbers
    ]
    staged = rows.withColumns(
        {
            "_plain": F.transform(entries("value"), strip),
            "_unit": entries("unit"),
            "_kind": entries("kind"),
            "_how": F.array(*how),
        }
    )
    staged = staged.withColumn("_number", F.transform("_plain", lambda v, i: _read(v, F.col("_kind")[i])))
    staged = staged.withColumn("_finite", F.transform("_number", finite))
    canonical = fixed([r.unit for r in numbers], "string")

    def converted(number: Column, i: Column) -> Column:
        as_is = canonical[i].isNull() | F.col("_unit")[i].isNull()
        return F.when(as_is, number).otherwise(convert(number, F.col("_how")[i]))

    # A conversion may overflow a number that was finite before.
    staged = staged.withColumn("_exact", F.transform("_finite", converted))
    staged = staged.withColumn("_result", F.transform(F.transform("_exact", finite), round3))

    name, required = fixed([r.name for r in numbers], "string"), fixed([r.required for r in numbers], "boolean")
    low, high = fixed([r.low for r in numbers], "double"), fixed([r.high for r in numbers], "double")
    outside = fixed(
        [f"{f' {r.unit}' if r.unit else ''} is outside the expected {r.low} to {r.high}" for r in numbers], "string"
    )

    def judged(result: Column, i: Column) -> Column:
        plain, unit, kind = F.col("_plain")[i], F.col("_unit")[i], F.col("_kind")[i]
        blank, numeric = plain.isNull() | (plain == ""), F.col("_finite")[i].isNotNull()
        unit_missing = canonical[i].isNotNull() & unit.isNull()
        unit_unknown = canonical[i].isNotNull() & unit.isNotNull() & F.col("_how")[i].isNull()
        value = F.element_at(entries("value"), i + 1)
        echo = (
            F.when(kind == "STRING", single_quoted(value))
            .when(value == "NaN", "nan")
            .when(value == "Infinity", "inf")
            .when(value == "-Infinity", "-inf")
            .otherwise(value)
        )
        doubts = F.array(
            F.when(blank & required[i], problem(name[i], "missing", ERROR, MISSING_TEXT)),
            F.when(
                ~blank & (~numeric | (result.isNull() & ~unit_unknown)),
                problem(
                    name[i], "not_a_number", ERROR,
                    F.concat(F.lit("Expected a finite number, got "), shortened(echo)),
                ),
            ),
            F.when(
                numeric & unit_missing,
                problem(
                    name[i], "missing_unit", WARNING, F.concat(F.lit("No unit given, assumed "), canonical[i])
                ),
            ),
            F.when(
                numeric & unit_unknown,
                problem(
                    name[i], "unknown_unit", ERROR,
                    F.concat(F.lit("Cannot convert unit "), single_quoted(unit), F.lit(" to "), canonical[i]),
                ),
            ),
            F.when(
                ~result.between(low[i], high[i]),
                problem(name[i], "out_of_range", WARNING, F.concat(shown(result), outside[i])),
            ),
        )
        # Most values are fine, which one test shows.
        in_range = F.coalesce(result.between(low[i], high[i]), F.lit(True))
        fine = result.isNotNull() & in_range & ~unit_missing
        return F.when(fine, F.array().cast(f"array<{PROBLEM.simpleString()}>")).otherwise(doubts)

    return staged.withColumn("_found", F.transform("_result", judged))


def _read(plain: Column, kind: Column) -> Column:
    return (
        F.when(kind == "BOOLEAN", (plain == "true").cast("double"))
        .when(kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), plain.try_cast("double"))
        .when(kind.isin("OBJECT", "ARRAY"), F.lit(None).cast("double"))
        .otherwise(as_double(plain))
    )


def _enum(rule: FieldRule, text: Column) -> tuple[Column, list[Column]]:
    spelling: dict[str, str] = {}
    for allowed in rule.allowed:
        spelling.setdefault(allowed.lower(), allowed)
    known = F.create_map(*[F.lit(part) for pair in spelling.items() for part in pair])
    canonical = F.try_element_at(known, F.lower(text))
    message = F.concat(single_quoted(text), F.lit(" is not one of: " + ", ".join(rule.allowed)))
    invalid = F.when(canonical.isNull(), problem(rule.name, "invalid_enum", WARNING, message))
    return F.coalesce(canonical, text), [F.when(text.isNotNull(), invalid)]


def _string(rule: FieldRule, text: Column) -> tuple[Column, list[Column]]:
    if not rule.pattern:
        return text, []
    # rlike searches; the anchors make it match the whole text.
    fits = text.rlike(rf"(?U)\A(?:{rule.pattern})\z")
    message = F.concat(
        single_quoted(text), F.lit(f" does not match the expected pattern {rule.pattern}")
    )
    return text, [F.when(~fits, problem(rule.name, "pattern_mismatch", WARNING, message))]


def validated(rows: DataFrame, rules: RuleSet, raw: str = "raw") -> DataFrame:
    """Replaces ``raw`` by ``data``, ``problems`` and ``status``. No shuffle.

    Problems come in rule order, within a field in the order of the checks. All number
    fields go through one chain of array transforms, each step evaluated once per value.
    """
    check_units(rules)
    numbers = [r for r in rules.fields if r.kind == "number"]
    texts = [r for r in rules.fields if r.kind != "number"]
    staged = _number_steps(rows, numbers, raw) if numbers else rows
    if texts:
        plain = F.transform(F.array(*[F.col(raw)[r.name] for r in texts]), strip)
        staged = staged.withColumn("_texts", F.transform(plain, lambda text: F.when(text != "", text)))
    values, found = [], []
    for rule in rules.fields:
        if rule.kind == "number":
            at = numbers.index(rule)
            value, problems = F.col("_result")[at], F.col("_found")[at]
        else:
            text = F.col("_texts")[texts.index(rule)]
            value, listed = (_enum if rule.kind == "enum" else _string)(rule, text)
            if rule.required:
                gap = problem(rule.name, "missing", ERROR, MISSING_TEXT)
                listed = [F.when(text.isNull(), gap), *listed]
            problems = F.array(*listed)
        values.append(value.alias(rule.name))
        if rule.kind == "number" or listed:
            found.append(problems)
    kept = [c for c in rows.columns if c != raw]
    listed = F.filter(F.flatten(F.array(*found)), lambda p: p.isNotNull())
    finished = {
        "data": F.struct(*values).cast(rules.data_type),
        "problems": listed.cast(f"array<{PROBLEM.simpleString()}>"),
    }
    return evaluated_once(staged, kept, finished).withColumn("status", status(F.col("problems")))


def status(problems: Column) -> Column:
    """error when any error, else warning when any problem, else ok."""
    return (
        F.when(F.exists(problems, lambda p: p["severity"] == ERROR), ERROR)
        .when(F.exists(problems, lambda p: p["severity"] == WARNING), WARNING)
        .otherwise(OK)
    )


def of_severity(problems: Column, severity: str) -> Column:
    """The problems of one severity, in order."""
    return F.filter(problems, lambda p: p["severity"] == severity)


def as_records(checked: DataFrame, rules: RuleSet, extracted_at: Column | None = None) -> DataFrame:
    """Record rows without an id from validated rows with their provenance."""
    names = rules.names
    lifted = [
        (F.col("data")[n] if n in names else F.lit(None).cast("string")).alias(n)
        for n in ("manufacturer", "part_number")
    ]
    kept = [c for c in ("seq",) if c in checked.columns]
    stamp = F.current_timestamp() if extracted_at is None else extracted_at
    return checked.select(
        *kept,
        F.lit(rules.component_type).alias("component_type"),
        *lifted,
        "source_file",
        "source_hash",
        "status",
        "data",
        "problems",
        stamp.alias("extracted_at"),
    )
