import itertools
import random
from collections import defaultdict

import pytest

from specmill.llm import chat
from specmill.llm.chat import NAMES, NEXT, Repair, RepairCosts, repaired

COSTS = RepairCosts()


def cheapest(roles):
    """Least cost over every choice for every turn."""
    best = {0: 0}
    for role in roles:
        now = {}
        for state, cost in best.items():
            for new in (1, 2, 3):
                label = 0 if NAMES[new] == role else COSTS.relabel + (0 if role in NAMES[1:] else COSTS.unknown)
                options = []
                if new == state:
                    options.append(COSTS.merge)
                if new in NEXT[state]:
                    options.append(0)
                if any(new in NEXT[m] for m in NEXT[state]):
                    options.append(COSTS.insert)
                for option in options:
                    now[new] = min(now.get(new, 10**9), cost + label + option)
        best = now
    return min(best.values())


def legal(rendered):
    parts = rendered.split("<|im_start|>")
    assert parts[0] == "" and all(p.endswith("<|im_end|>\n") for p in parts[1:])
    state = 0
    for name in [p.split("\n", 1)[0] for p in parts[1:]]:
        assert NAMES.index(name) in NEXT[state]
        state = NAMES.index(name)


@pytest.mark.parametrize("piece_bits", [12, 2])
def test_against_every_choice(spark, monkeypatch, piece_bits):
    monkeypatch.setattr(chat, "PIECE_BITS", piece_bits)
    rng = random.Random(12)
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(rng.choice([1, 2, 3, 7, 30])):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", " User", "tool", None])
            rows.append((conv, turn if rng.random() < 0.8 else rng.choice([1, None]), role, rng.choice(["", None, f"t{turn}"])))
    rows += [rows[0]] * 3 + [(500, 0, "user", "x" * 100_000)] + [(501, 7, "user", "same")] * 20
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, cost int")
    got = repaired(turns).collect()
    assert sorted((repr((r.conv_id, r.turn, r.role)) for r in got)) == sorted(repr(r[:3]) for r in rows)
    by_conv = defaultdict(list)
    for r in got:
        by_conv[r.conv_id].append(r)
    for found in by_conv.values():
        found.sort(key=lambda r: (r.turn is not None, r.turn or 0, r.position))
        order = sorted(found, key=lambda r: r.position)
        assert sum(r.cost for r in found) == min(
            cheapest([(r.role or "").strip().lower() for r in p]) for p in _orders(found)
        )
        # Rows of one repaired turn are merged into its first.
        by_turn = defaultdict(list)
        for r in order:
            by_turn[r.position].append(r)
        text = ""
        for position in sorted(by_turn):
            same = by_turn[position]
            assert len({r.new_role for r in same}) == 1 and sum(r.action != "merge" for r in same) == 1
            same.sort(key=lambda r: (r.action == "merge", "<|im_end|>\n" in r.segment[-11:]))
            text += "".join(r.segment for r in same)
        legal(text)
    assert len(by_conv[501]) == 20 and {r.position for r in by_conv[501]} == {0}


def _orders(found):
    """The one order in use: turns with ties stand as they were dealt."""
    yield sorted(found, key=lambda r: (r.turn is not None, r.turn or 0, (r.role is not None, r.role or ""), 0))


def test_pieces_cost_as_much_as_the_whole():
    repair, rng = Repair(COSTS), random.Random(3)
    for _ in range(60):
        roles = [rng.randrange(4) for _ in range(rng.randrange(1, 12))]
        cut = sorted(rng.sample(range(1, len(roles) + 1), rng.randrange(0, min(3, len(roles)) + 1)) + [0, len(roles)])
        pieces = [roles[a:b] for a, b in itertools.pairwise(cut)]
        states, begun = repair.through([repair.matrix(p) for p in pieces])
        whole = repair.path(roles)
        parts = [m for i, p in enumerate(pieces) for m in repair.path(p, states[i], states[i + 1])]
        assert sum(m[0] for m in parts) == sum(m[0] for m in whole)
        assert begun[-1] == sum(m[0] for m in whole) % chat.COST


def test_rendering(spark):
    rows = [(1, 0, "assistant", "hi"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = repaired(turns).orderBy("turn").collect()
    assert "".join(r.segment for r in got) == (
        "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n"
        "<|im_start|>user\na\nb<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    )
    assert [(r.action, r.cost, r.position) for r in got] == [("insert+keep", 2, 1), ("keep", 0, 2), ("merge", 1, 2), ("keep", 0, 3)]
    assert repaired(turns.where("false")).collect() == []
