"""Upsert against a plain sequential model, and the literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from specmill.operators.components import connected_components
from specmill.operators.upsert import by_id, record_count, upserted

COLUMNS = (
    "id long, component_type string, manufacturer string, part_number string, source_file string, "
    "source_hash string, status string, data string, problems string, extracted_at timestamp"
)
BATCH = COLUMNS.replace("id long", "seq long")


def sequential(current, batch):
    rows = {r["id"]: dict(r) for r in current}
    report = {}
    for b in sorted(batch, key=lambda r: r["seq"]):
        found = [i for i in sorted(rows) if rows[i]["source_hash"] == b["source_hash"]]
        if not found and b["part_number"]:
            found = [
                i for i in sorted(rows)
                if (rows[i]["manufacturer"], rows[i]["part_number"]) == (b["manufacturer"], b["part_number"])
            ]
        created = not found
        target = found[0] if found else max(rows, default=0) + 1
        rows[target] = {**b, "id": target}
        report[b["seq"]] = (target, created)
    return rows, report


def row(seq, maker, part, digest):
    return {
        "seq": seq, "component_type": "sensor", "manufacturer": maker, "part_number": part,
        "source_file": f"f{seq}.pdf", "source_hash": digest, "status": "ok", "data": f"d{seq}",
        "problems": "[]", "extracted_at": None,
    }


def compare(spark, current, batch, bits):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    cur = spark.createDataFrame([tuple(r[n] for n in names) for r in current], COLUMNS)
    names[0] = "seq"
    new = spark.createDataFrame([tuple(r[n] for n in names) for r in batch], BATCH)
    table, report = upserted(cur, new, bits)
    rows, told = sequential(current, batch)
    got = {r["id"]: (r["source_hash"], r["part_number"], r["data"]) for r in table.collect()}
    assert got == {i: (r["source_hash"], r["part_number"], r["data"]) for i, r in rows.items()}
    assert {r["seq"]: (r["record_id"], r["created"]) for r in report.collect()} == told


def random_rows(rng, n, start, makers, parts, hashes):
    return [
        row(start + i * rng.choice([1, 1, 3]) * 1 + i * 3, rng.choice(makers), rng.choice(parts), f"h{rng.randrange(hashes)}")
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_sequential_procedure(spark, seed):
    # Many small independent cases in one table: case number goes into every key.
    rng = random.Random(seed)
    current, batch, seqs = [], [], 0
    for case in range(60):
        makers = [None, f"m{case}"] if rng.random() < 0.3 else [f"m{case}"]
        parts = [f"p{i}" for i in range(rng.randrange(1, 4))] + ([None, ""] if rng.random() < 0.4 else [])
        parts = [p if not p else f"c{case}{p}" for p in parts]
        hashes = rng.randrange(2, 9)
        history = []
        for _ in range(rng.randrange(0, 6)):
            history.append(row(seqs, rng.choice(makers), rng.choice(parts), f"c{case}h{rng.randrange(hashes)}"))
            seqs += rng.randrange(1, 4)
        rows, _ = sequential(current, history)
        current = list(rows.values())
    # Ids are spread over cases; now a batch that interleaves all of them.
        batch += [(rng.random(), case, makers, parts, hashes) for _ in range(rng.randrange(0, 9))]
    batch.sort(key=lambda b: b[0])
    events, seq = [], 0
    for _, case, makers, parts, hashes in batch:
        events.append(row(seq, rng.choice(makers), rng.choice(parts), f"c{case}h{rng.randrange(hashes)}"))
        seq += rng.randrange(1, 4)
    for r in current:
        r.pop("seq", None)
    compare(spark, current, events, bits=3)


def test_hot_identity_without_and_with_movers(spark):
    rng = random.Random(3)
    hot = [row(i, "m", "hot", f"f{i}") for i in range(300)]
    hot += [row(300 + i, "m", "hot", f"r{rng.randrange(4)}") for i in range(300)]
    compare(spark, [], hot, bits=5)
    for r in hot[::97]:
        r["part_number"] = "other"
    for i in (350, 420, 500):
        hot[i]["part_number"] = f"x{i}"
    compare(spark, [], hot, bits=5)


def test_revision_and_rewording_keep_the_id(spark):
    first = {**row(0, "Nordlicht", "NL-770", "a"), "id": 7}
    compare(spark, [first], [row(0, "Nordlicht", "NL-770", "b"), row(1, "Nordlicht", "Level NL-770", "b")], bits=20)
    compare(spark, [], [row(5, None, "X", "a"), row(9, None, "X", "b"), row(11, None, None, "c"), row(12, "", "X", "d")], bits=20)


def test_lookup_and_count(spark):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    rows = [{**row(i, "m", f"p{i}", f"h{i}"), "id": i} for i in range(3)]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], COLUMNS)
    assert by_id(df, 2).first()["part_number"] == "p2" and by_id(df, 9).first() is None
    assert record_count(df).first()["records"] == 3


def test_components(spark):
    rng = random.Random(5)
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(0, 60) if i % 13]
    edges += [("hub", f"s{i}") for i in range(40)] + [(f"t{rng.randrange(30)}", f"t{rng.randrange(30)}") for _ in range(25)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: find(n) for n in parent}
