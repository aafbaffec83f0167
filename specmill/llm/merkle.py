"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf of its tree's Merkle tree, the roots of all trees are the leaves of one more. Nodes are labelled level by
level, so a parent's label is greater than its children's. A priority queue ordered by label carries each child's digest forward to its
parent; a second sweep in the opposite order carries each parent's proof suffix (the siblings from it up to the root) back to
its children, until the leaves hold whole proofs.

The queue is external: labels are cut into ranges, a block of ``2**bits`` neighbouring nodes and the ``bits`` levels above
it. Messages inside a range wait in a heap of bounded size, messages that leave it are written as the table of the next round, which
Spark shuffles and sorts by label. A tree of n leaves takes log(n) / bits rounds, whatever its share of the rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from specmill.llm.common import fold_of, grouped
from specmill.session import settled

# An entry of a proof suffix: the sibling's side, then its digest. A node alone in its run has no sibling.
LEFT, RIGHT, ALONE = "L", "R", "N" + "-" * 64
ENTRY = 65


@dataclass(frozen=True)
class MerkleSettings:
    """``bits``: levels of one round, a block has at most ``2**bits`` nodes."""

    bits: int = 10


def digest_of(parts: str) -> str:
    return sha256(parts.encode("ascii")).hexdigest()


def levels_above(total: int, bits: int) -> int:
    """Levels of a block of a tree with ``total`` nodes: the tree ends where one node remains."""
    return min(bits, (total - 1).bit_length())


def forward(digests: list[str], levels: int) -> list[list[str]]:
    """All digests of a block, a list per level, the given nodes first.

    A message is (label of the receiver, place among its children, digest). The least label is processed first; its two
    messages at most are all that is known of its children.
    """
    width = len(digests)
    rows, starts = [digests], [0, width]
    queue = [(width + i // 2, i % 2, d) for i, d in enumerate(digests)] if levels else []
    heapq.heapify(queue)
    for level in range(1, levels + 1):
        count = (len(rows[-1]) + 1) // 2
        starts.append(starts[-1] + count)
        row = []
        for label in range(starts[level], starts[level + 1]):
            joined = ""
            while queue and queue[0][0] == label:
                joined += heapq.heappop(queue)[2]
            row.append(digest_of(joined))
            if level < levels:
                at = label - starts[level]
                heapq.heappush(queue, (starts[level + 1] + at // 2, at % 2, row[-1]))
        rows.append(row)
    return rows


def backward(rows: list[list[str]], suffix: str):
    """(place, proof suffix) of the given nodes of a block whose root has ``suffix``, from its last label down to the first.

    The queue holds suffixes by falling label; a node hands its own, with the sibling in front, to each child.
    """
    starts = [0]
    for row in rows:
        starts.append(starts[-1] + len(row))
    queue = [(-(starts[-2]), suffix)]
    level = len(rows) - 1
    while queue:
        label, held = heapq.heappop(queue)
        while -label < starts[level]:
            level -= 1
        at = -label - starts[level]
        if level == 0:
            yield at, held
            continue
        below = rows[level - 1]
        first, second = 2 * at, 2 * at + 1
        if second < len(below):
            heapq.heappush(queue, (-(starts[level - 1] + first), RIGHT + below[second] + held))
            heapq.heappush(queue, (-(starts[level - 1] + second), LEFT + below[first] + held))
        else:
            heapq.heappush(queue, (-(starts[level - 1] + first), ALONE + held))


def proof_digest(suffix: str) -> str:
    """H of all siblings of a whole proof, in its order."""
    return digest_of("".join(suffix[i + 1 : i + ENTRY] for i in range(0, len(suffix), ENTRY) if suffix[i] != "N"))


def folded(digest: str, suffix: str) -> str:
    """The root that ``digest`` and the siblings of its proof give."""
    for i in range(0, len(suffix), ENTRY):
        side, other = suffix[i], suffix[i + 1 : i + ENTRY]
        digest = digest_of(other + digest if side == LEFT else digest + other if side == RIGHT else digest)
    return digest


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in columns]).cast("binary"), 256)


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Adds ``_i``, the place of each row in its tree from 0, and ``_total``, the tree's size; ``order`` has no ties.

    Rows are sorted in ranges; a row's place is its place in the range plus the counts of the ranges before. A tree that
    holds all rows is spread over all ranges.
    """
    spread = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    spread = settled(spread.withColumn("_at", F.monotonically_increasing_id()), "merkle-order")
    cut = spread.withColumn("_range", F.shiftright("_at", 33))
    runs = cut.groupBy(tree, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(tree)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        tree,
        "_range",
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(whole).alias("_total"),
    )
    placed = cut.join(runs, [tree, "_range"]).withColumn("_i", F.col("_at") + F.col("_shift"))
    return placed.drop("_at", "_range", "_shift")


def raised(nodes: DataFrame, settings: MerkleSettings) -> DataFrame:
    """The nodes ``bits`` levels up, one per block: (_tree, _i, _total, _digest)."""
    bits = settings.bits

    def sweep(batches):
        for block in grouped(batches, ("_tree", "_block")):
            total = block["_total"][0]
            top = forward(block["_digest"], levels_above(total, bits))[-1][0]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block["_tree"][0]], pa.string()),
                    pa.array([block["_block"][0]], pa.int64()),
                    pa.array([-(-total >> bits)], pa.int64()),
                    pa.array([top], pa.string()),
                ],
                names=["_tree", "_i", "_total", "_digest"],
            )

    return blocks_of(nodes.select("_tree", "_i", "_total", "_digest"), settings).mapInArrow(
        sweep, "_tree string, _i bigint, _total bigint, _digest string"
    )


def blocks_of(nodes: DataFrame, settings: MerkleSettings) -> DataFrame:
    """Nodes dealt by block, in the order of their labels."""
    cut = nodes.withColumn("_block", F.shiftright("_i", settings.bits))
    return cut.repartition("_tree", "_block").sortWithinPartitions("_tree", "_block", "_i")


def heightened(nodes: DataFrame, settings: MerkleSettings) -> list[DataFrame]:
    """``nodes`` and the nodes of every further round; in the last one each tree has a single node."""
    rounds = [nodes]
    most = nodes.agg(F.max("_total")).first()[0] or 0
    while most > 1:
        rounds.append(settled(raised(rounds[-1], settings), "merkle-round"))
        most = -(-most >> settings.bits)
    return rounds


def under_tops(nodes: DataFrame, tops: DataFrame, settings: MerkleSettings) -> DataFrame:
    """``nodes`` dealt by block in the order of their labels, each block after the row of ``tops`` that is its root."""
    heads = tops.withColumnRenamed("_i", "_block").withColumn("_i", F.lit(-1).cast("bigint"))
    cut = nodes.withColumn("_block", F.shiftright("_i", settings.bits))
    rows = cut.unionByName(heads, allowMissingColumns=True)
    return rows.repartition("_tree", "_block").sortWithinPartitions("_tree", "_block", "_i")


def swept_back(block: dict, bits: int):
    """(place, suffix) of the nodes of a block that follows its root's row."""
    levels = forward(block["_digest"][1:], levels_above(block["_total"][1], bits))
    return backward(levels, block["_suffix"][0])


TOP_COLUMNS = ["_tree", "_i", "_suffix", "_subroot", "_root"]
TOPS = "_tree string, _i bigint, _suffix string, _subroot string, _root string"


def lowered(nodes: DataFrame, tops: DataFrame, settings: MerkleSettings) -> DataFrame:
    """``tops`` (suffix, subroot and root of every block's root) one round down: the same of all ``nodes``."""
    bits = settings.bits

    def sweep(batches):
        for block in grouped(batches, ("_tree", "_block")):
            places, suffixes = zip(*swept_back(block, bits))
            first, size = block["_i"][1], len(places)
            columns = [
                [block["_tree"][0]] * size,
                [first + at for at in places],
                suffixes,
                [block["_subroot"][0]] * size,
                [block["_root"][0]] * size,
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64() if name == "_i" else pa.string()) for c, name in zip(columns, TOP_COLUMNS)],
                names=TOP_COLUMNS,
            )

    held = nodes.select("_tree", "_i", "_total", "_digest")
    return under_tops(held, tops, settings).mapInArrow(sweep, TOPS)


def proven(leaves: DataFrame, tops: DataFrame, settings: MerkleSettings) -> DataFrame:
    """Per leaf (_key, _digest, _shown) its roots, its proof's digest and the root that ``_shown`` folds to."""
    bits = settings.bits
    kind = leaves.select("_key").schema

    def sweep(batches):
        key_type = to_arrow_schema(kind).field("_key").type
        for block in grouped(batches, ("_tree", "_block")):
            size = len(block["_digest"]) - 1
            proofs, roots = [None] * size, [None] * size
            for at, suffix in swept_back(block, bits):
                proofs[at] = proof_digest(suffix)
                roots[at] = folded(block["_shown"][at + 1], suffix)
            columns = [block["_digest"][1:], [block["_subroot"][0]] * size, [block["_root"][0]] * size, proofs, roots]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block["_key"][1:], key_type), *[pa.array(c, pa.string()) for c in columns]],
                names=["_key", "_digest", "_subroot", "_root", "_proof", "_folded"],
            )

    return under_tops(leaves, tops, settings).mapInArrow(
        sweep,
        f"_key {kind['_key'].dataType.simpleString()}, _digest string, _subroot string, _root string, "
        "_proof string, _folded string",
    )


def manifest(leaves: DataFrame, settings: MerkleSettings = MerkleSettings()) -> DataFrame:
    """Proofs of ``leaves`` (_key, _tree, _digest, _shown): (_key, _digest, _subroot, _root, _proof, _folded), a row each.

    Leaves of a tree ascend by ``_key`` (null first), then by digest; equal ones may change places, which changes no
    root and no set of rows. Trees ascend by their name's bytes. ``_shown`` is the digest that is put to the proof.
    """
    fixed = settled(leaves.withColumn("_tie", F.monotonically_increasing_id()), "merkle-leaves")
    nodes = settled(numbered(fixed, "_tree", ["_key", "_digest", "_tie"]).drop("_tie"), "merkle-nodes")
    rounds = heightened(nodes, settings)
    subroots = rounds[-1].select(F.lit("").alias("_tree"), F.col("_tree").alias("_name"), "_digest")
    trees = settled(numbered(subroots, "_tree", ["_name"]), "merkle-trees")
    upper = heightened(trees, settings)
    # The backward sweep begins at the root, whose suffix is empty.
    tops = upper[-1].select("_tree", "_i", F.lit("").alias("_suffix"), F.lit("").alias("_subroot"), F.col("_digest").alias("_root"))
    for below in upper[-2::-1]:
        tops = settled(lowered(below, tops, settings), "merkle-suffixes")
    tops = trees.join(tops.drop("_tree"), "_i").select(
        F.col("_name").alias("_tree"),
        F.lit(0).cast("bigint").alias("_i"),
        "_suffix",
        F.col("_digest").alias("_subroot"),
        "_root",
    )
    for below in rounds[-2:0:-1]:
        tops = settled(lowered(below, tops, settings), "merkle-suffixes")
    return proven(nodes, tops, settings)


def document_manifest(
    docs: DataFrame,
    key: str = "doc_id",
    tree: str = "lang",
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    settings: MerkleSettings = MerkleSettings(),
) -> DataFrame:
    """Leaf, subroot, root, proof and a check with tampered rows: a row per row of ``docs``.

    A leaf is H of ``columns`` in order. Leaves of one ``tree`` value (null is a value of its own, the first) ascend by
    ``key``, null keys first, ties by leaf. Rows whose key has an unsigned crc32 of its decimal text divisible by 7 are put to the
    proof with ``n_chars`` one higher; null keys and null counts stay as they are. Repeated rows are leaves of their own.
    An empty table gives no rows. Further columns are ignored, whatever their names.
    """
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string")
    shown = leaf_of([more if name == "n_chars" else F.col(name) for name in columns])
    plain = leaf_of([F.col(name) for name in columns])
    changed = (fold_of(F.col(key), 7) == 0) & F.col("n_chars").isNotNull()
    leaves = docs.select(
        F.col(key).alias("_key"),
        # Null comes before every text, the empty one included.
        F.coalesce(F.concat(F.lit("1"), F.col(tree).cast("string")), F.lit("0")).alias("_tree"),
        plain.alias("_digest"),
        F.when(changed, shown).alias("_shown"),
    ).withColumn("_shown", F.coalesce("_shown", "_digest"))
    return manifest(leaves, settings).select(
        F.col("_key").alias(key),
        F.col("_digest").alias("leaf"),
        F.col("_subroot").alias("subroot"),
        F.col("_root").alias("root"),
        F.col("_proof").alias("proof_sha256"),
        F.col("_folded").alias("folded_root"),
        (F.col("_folded") == F.col("_root")).alias("verified"),
    )
