"""Minimum-cost repair of chat roles, and rendering.

A legal conversation is an optional system turn, then user and assistant turns in alternation from a user turn on. Each given turn
may be kept, relabelled, merged into the turn before it, or preceded by an empty turn of the missing role, each at
a cost. What a stretch of turns costs between any two states of the automaton is a small matrix, and stretches join
by adding and taking the least. So a conversation that is cut over several tasks is solved exactly: one matrix
per piece, one path through the pieces, then the turns inside every piece.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from specmill.llm.common import grouped
from specmill.session import settled

# States of the automaton: what the conversation ended with so far.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
# Legal next roles by state.
NEXT = {BEGIN: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
# Costs are compared first, then the number of turns begun: one integer holds both.
COST = 1 << 32
IMPOSSIBLE = 1 << 61
# Rows of one piece; a piece is solved by itself.
PIECE_BITS = 12


@dataclass(frozen=True)
class RepairCosts:
    """Costs of one step each. ``unknown`` is added where a missing or unknown role gets any label.

    Merging keeps what was said by whom, an empty turn adds nothing to it, a new label changes it.
    """

    merge: int = 1
    insert: int = 2
    relabel: int = 3
    unknown: int = 1


@dataclass(frozen=True)
class Template:
    """``head`` is formatted with the role before a turn, ``tail`` follows it, ``joint`` is put between merged texts."""

    head: str = "<|im_start|>{}\n"
    tail: str = "<|im_end|>\n"
    joint: str = "\n"


class Repair:
    """The moves a turn can make, by its own role: (key, from, inserted role or 0, action) for every state it can end in."""

    def __init__(self, costs: RepairCosts):
        self.moves = [self._moves(own, costs) for own in range(4)]

    @staticmethod
    def _moves(own: int, costs: RepairCosts) -> list[list[tuple[int, int, int, str]]]:
        moves: list[list[tuple[int, int, int, str]]] = [[], [], [], []]
        for end in (SYSTEM, USER, ASSISTANT):
            label = 0 if own == end else costs.relabel + (0 if own else costs.unknown)
            named = "keep" if own == end else "relabel"
            for start in range(4):
                if end in NEXT[start]:
                    moves[end].append((label * COST + 1, start, 0, named))
                for between in NEXT[start]:
                    if end in NEXT[between]:
                        moves[end].append(((label + costs.insert) * COST + 2, start, between, f"insert+{named}"))
            # A merged turn takes the role of the turn it joins.
            moves[end].append(((costs.merge + label) * COST, end, 0, "merge"))
            moves[end].sort()
        return moves

    def forward(self, roles: list[int], before: list[int]) -> list[list[int]]:
        """Least keys of the states before the first turn and after every one."""
        out = [before]
        for own in roles:
            last, now = out[-1], [IMPOSSIBLE] * 4
            for end in (SYSTEM, USER, ASSISTANT):
                now[end] = min(min(last[start] + key for key, start, _, _ in self.moves[own][end]), IMPOSSIBLE)
            out.append(now)
        return out

    def matrix(self, roles: list[int]) -> list[list[int]]:
        """Least keys of all turns together, from every state to every state."""
        starts = [[0 if s == at else IMPOSSIBLE for s in range(4)] for at in range(4)]
        return [self.forward(roles, start)[-1] for start in starts]

    def path(self, roles: list[int], start: int = BEGIN, end: int | None = None) -> list[tuple[int, int, int, int, str]]:
        """(key, from, to, inserted, action) of every turn on the least path, to ``end`` if given.

        Ties go to the lower end state, then to the move that comes first in order.
        """
        keys = self.forward(roles, [0 if s == start else IMPOSSIBLE for s in range(4)])
        at = keys[-1].index(min(keys[-1])) if end is None else end
        moves = []
        for i in range(len(roles) - 1, -1, -1):
            key, before, inserted, action = min(
                self.moves[roles[i]][at], key=lambda m: (keys[i][m[1]] + m[0], m[1], m[2])
            )
            moves.append((key, before, at, inserted, action))
            at = before
        return moves[::-1]

    def through(self, matrices: list[list[list[int]]]) -> tuple[list[int], list[int]]:
        """States at the cuts of a conversation in pieces, and the turns begun before each cut."""
        keys = [[0, IMPOSSIBLE, IMPOSSIBLE, IMPOSSIBLE]]
        for matrix in matrices:
            keys.append([min(min(keys[-1][s] + matrix[s][e] for s in range(4)), IMPOSSIBLE) for e in range(4)])
        at = keys[-1].index(min(keys[-1]))
        states = [at]
        for i in range(len(matrices) - 1, -1, -1):
            at = min(range(4), key=lambda s: (keys[i][s] + matrices[i][s][at], s))
            states.append(at)
        states.reverse()
        begun = [0]
        for i, matrix in enumerate(matrices):
            begun.append(begun[-1] + matrix[states[i]][states[i + 1]] % COST)
        return states, begun


def repaired(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    costs: RepairCosts = RepairCosts(),
    template: Template = Template(),
) -> DataFrame:
    """(conversation, turn, position, role, new_role, action, cost, segment), a row per row of ``turns``.

    Turns stand in the order of ``turn`` (nulls first; ties by role, then by a hash of the text). ``position`` is the number of the repaired turn, from 0, in which
    the row ends up, ``new_role`` its role, ``action`` keep, relabel, merge or insert+keep, insert+relabel for an empty
    turn put before it; ``cost`` is that of the row. Segments, joined in order, are the rendered conversation:
    each holds the empty turn put before, the head of a turn that begins, and the text; the tail of a turn stands
    before what begins the next one, and the row that ends the conversation closes it.

    A null conversation id is one conversation. A null text is an empty one. A missing or unknown role takes the cheapest
    label. Repeated rows are turns of their own. An empty table gives no rows.

    Rows are sorted into ranges of (conversation, turn), so a conversation that holds much of the table is cut
    over many tasks; its pieces of a few thousand rows are joined by their matrices.
    """
    kind = turns.schema[conversation].dataType.simpleString()
    repair = Repair(costs)
    own = F.lower(F.trim(F.coalesce(F.col(role).cast("string"), F.lit(""))))
    code = F.lit(0)
    for number in (SYSTEM, USER, ASSISTANT):
        code = F.when(own == NAMES[number], number).otherwise(code)
    # Equal rows are told apart by where they stand, or they could not be dealt out.
    rows = turns.select(
        F.col(conversation).alias("_c"),
        F.col(turn).alias("_t"),
        F.col(role).alias("_r"),
        F.col(text).alias("_x"),
        F.xxhash64(text).alias("_h"),
        F.monotonically_increasing_id().alias("_m"),
        code.alias("_own"),
    )
    session = turns.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    order = ("_c", "_t", "_r", "_h", "_m")
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    numbered = settled(
        dealt.select(
            "_c", "_t", "_r", "_x", "_own", place.alias("_i"), F.shiftright(place, PIECE_BITS).alias("_piece")
        ),
        "chat-sorted",
    )
    narrow = numbered.select("_piece", "_i", "_c", "_own")

    conversation_type = to_arrow_type(turns.schema[conversation].dataType)

    def outline(batches):
        for group in grouped(batches, ("_piece",)):
            runs = _runs(group["_c"])
            ends = [runs[0]] if len(runs) == 1 else [runs[0], runs[-1]]
            keys = [repair.matrix(group["_own"][start:stop]) for start, stop in ends]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([group["_piece"][0]] * len(ends), pa.int64()),
                    pa.array([start for start, _ in ends], pa.int64()),
                    pa.array([group["_c"][start] for start, _ in ends], conversation_type),
                    pa.array([[x for row in key for x in row] for key in keys], pa.list_(pa.int64())),
                ],
                names=["_piece", "_first", "_c", "_keys"],
            )

    outlines = (
        narrow.repartition("_piece")
        .sortWithinPartitions("_piece", "_i")
        .mapInArrow(outline, f"_piece bigint, _first bigint, _c {kind}, _keys array<bigint>")
    )

    def joint(batches):
        for group in grouped(batches, ("_c",)):
            matrices = [[keys[i : i + 4] for i in range(0, 16, 4)] for keys in group["_keys"]]
            states, begun = repair.through(matrices)
            count = len(matrices)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(group["_piece"], pa.int64()),
                    pa.array(group["_first"], pa.int64()),
                    pa.array([[states[i], states[i + 1], begun[i], int(i == count - 1)] for i in range(count)], pa.list_(pa.int64())),
                ],
                names=["_piece", "_first", "_cut"],
            )

    cuts = settled(
        outlines.repartition("_c")
        .sortWithinPartitions("_c", "_piece")
        .mapInArrow(joint, "_piece bigint, _first bigint, _cut array<bigint>"),
        "chat-cuts",
    )
    none = F.lit(None)
    stream = cuts.select(
        "_piece", "_first", "_cut", F.lit(-1).cast("bigint").alias("_i"), none.cast(kind).alias("_c"), F.lit(0).alias("_own")
    ).unionByName(
        narrow.select(
            "_piece", none.cast("bigint").alias("_first"), none.cast("array<bigint>").alias("_cut"), "_i", "_c", "_own"
        )
    )

    def solve(batches):
        for group in grouped(batches, ("_piece",)):
            known = sum(i < 0 for i in group["_i"])
            cut = dict(zip(group["_first"][:known], group["_cut"][:known]))
            codes, out = group["_own"][known:], []
            for start, stop in _runs(group["_c"][known:]):
                first, last, begun, final = cut.get(start, (BEGIN, None, 0, 1))
                for at, (key, before, to, inserted, action) in enumerate(repair.path(codes[start:stop], first, last)):
                    begun += key % COST
                    if action == "merge":
                        head = template.joint
                    else:
                        head = template.tail if before else ""
                        head += template.head.format(NAMES[inserted]) + template.tail if inserted else ""
                        head += template.head.format(NAMES[to])
                    tail = template.tail if final and at == stop - start - 1 else ""
                    out.append((begun - 1, NAMES[to], action, key // COST, head, tail))
            position, new_role, action, cost, head, tail = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(group["_i"][known:], pa.int64()),
                    pa.array(position, pa.int64()),
                    pa.array(new_role, pa.string()),
                    pa.array(action, pa.string()),
                    pa.array(cost, pa.int64()),
                    pa.array(head, pa.string()),
                    pa.array(tail, pa.string()),
                ],
                names=["_i", "position", "new_role", "action", "cost", "_head", "_tail"],
            )

    decided = (
        stream.repartition("_piece")
        .sortWithinPartitions("_piece", "_i")
        .mapInArrow(
            solve,
            "_i bigint, position bigint, new_role string, action string, cost bigint, _head string, _tail string",
        )
    )
    return numbered.join(decided, "_i").select(
        F.col("_c").alias(conversation),
        F.col("_t").alias(turn),
        "position",
        F.col("_r").alias(role),
        "new_role",
        "action",
        "cost",
        F.concat("_head", F.coalesce(F.col("_x"), F.lit("")), "_tail").alias("segment"),
    )


def _runs(values: list) -> list[tuple[int, int]]:
    """Stretches of equal neighbours."""
    starts = [i for i in range(len(values)) if i == 0 or values[i] != values[i - 1]]
    return list(zip(starts, [*starts[1:], len(values)]))
