import random
from collections import defaultdict

from specmill.llm import mixing
from specmill.llm.mixing import mixed, schedule, scheduled_blocks, source_targets, with_closing


def targets_by_hand(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        left = sum(weight[s] for s in names if s not in full)
        target = {s: cap * sizes[s] if s in full else rest * weight[s] / left for s in names}
        above = {s for s in names if target[s] > cap * sizes[s] + 1e-9}
        if not above:
            return target
        full |= above


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id bigint, text string, source string, size int")


def test_whole_mix(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randrange(1, 3) for _ in range(rng.choice([0, 1, 5, 40, 300]))), rng.choice(["b", "a", "é", None, "z", "z", "z", "Z"])) for i in range(400)]
    rows += [(5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2]), (None, "x\x0by\u00a0z w", "a"), (901, None, "only null"), (902, "a\tb\x0cc ", "b")]
    docs = table(spark, rows)
    got = mixed(docs, block=16).collect()
    assert len(got) == len(rows)
    size, source_of = defaultdict(list), {}
    for i, t, s in rows:
        n = len([w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t or "").split(" ") if w])
        size[i].append(n)
        source_of[i] = s
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.size in size[r.doc_id] and 0 <= r.taken <= 2 * r.size
        sizes[source_of[r.doc_id]] += r.size
        taken[source_of[r.doc_id]] += r.taken
    target = targets_by_hand(sizes)
    for r in got:
        assert r.source_size == sizes[source_of[r.doc_id]]
        assert abs(r.target - target[source_of[r.doc_id]]) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    again = mixed(docs.repartition(3, "text"), block=16).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_schedule_is_even(spark):
    sizes = spark.createDataFrame([(False, "a", 4000), (False, "b", 9000), (True, "", 8000)], "_none boolean, _source string, source_size bigint")
    targets = source_targets(sizes)
    want = {(r._none, r._source): r.target for r in targets.collect()}
    slots = schedule(targets, 16).collect()
    total = int(sum(want.values()) // 16)
    assert sorted(r.slot for r in slots) == list(range(total))
    for prefix in (100, 500, total):
        for name, target in want.items():
            share = target / sum(want.values()) * prefix
            assert abs(sum(r.slot < prefix and (r._none, r._source) == name for r in slots) - share) < 8
    blocks = scheduled_blocks(targets, 16).where("_source = 'a'").orderBy("slot").collect()
    assert [r._rank for r in blocks] == list(range(len(blocks)))
    assert [r._block for r in blocks] == [i % 250 for i in range(len(blocks))]


def test_no_rows_and_no_words(spark):
    docs = table(spark, [(1, None, None), (2, "", "a")])
    assert mixed(docs.where("false")).collect() == []
    assert [(r.size, r.target, r.taken) for r in mixed(docs).collect()] == [(0, 0.0, 0)] * 2


def test_plan_has_no_python(spark):
    plan = mixed(table(spark, [(1, "a b", "s")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def small_mix(spark, block=16):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.choice([1, 7, 30, 70])), rng.choice(["a", "b", "b", None])) for i in range(60)]
    return sorted(mixed(table(spark, rows), block=block).collect(), key=lambda r: r.doc_id), dict((r[0], r[2]) for r in rows)


def test_taken_is_what_the_slots_deal(spark, monkeypatch):
    """Word by word: each slot hands out the words of its block, one by one."""
    kept = {}

    def noted(*args):
        kept["slots"] = with_closing(*args)
        return kept["slots"]

    monkeypatch.setattr(mixing, "with_closing", noted)
    got, source_of = small_mix(spark)
    words = defaultdict(int)
    for r in kept["slots"].collect():
        for at in range(r._block * 16, r._block * 16 + r._words):
            words[None if r._none else r._source, at] += 1
    for r in got:
        assert r.taken == sum(words[source_of[r.doc_id], at] for at in range(r.first_word, r.first_word + r.size))
    closing = [r for r in kept["slots"].collect() if r.slot is None]
    assert len(closing) <= 3 * len({r._source for r in kept["slots"].collect()})


def test_the_schedule_decides(spark, monkeypatch):
    got, _ = small_mix(spark)
    plain = mixing.scheduled_blocks
    monkeypatch.setattr(mixing, "scheduled_blocks", lambda t, b: plain(t, b).where("_rank <> 3"))
    fewer, _ = small_mix(spark)
    assert sum(r.taken for r in got) - sum(r.taken for r in fewer) == 16 * 3
    monkeypatch.setattr(mixing, "scheduled_blocks", lambda t, b: plain(t, b).withColumn("_block", (mixing.F.col("_block") + 1) % 3))
    other, _ = small_mix(spark)
    assert [r.taken for r in other] != [r.taken for r in got]
