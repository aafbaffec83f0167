"""Benchmark decontamination with a generalised suffix automaton over the words of the items.

The automaton has one state per class of word runs that occur in the same places of the items. Training text
is streamed through it: after every word the state and the length of the longest
run that also occurs in an item are known. Runs as long as a window mark the words they cover.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmill.llm.common import as_bytes, packed, plain_words, slices, unpacked
from specmill.session import settled

# Words of items in one automaton. Larger benchmarks are cut into several, used one after the other.
AUTOMATON_WORDS = 400_000


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the windows of each item marked in it.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.
    """

    def __init__(self, items: list[list[bytes]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in item] for item in items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for item in coded:
            last = 0
            for word in item:
                last = self._extended(last, word)
        # Items by the state of a full window, and by (state, length) of a shorter one.
        self.full: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        self.least = window
        for number, item in enumerate(coded):
            state, length = 0, 0
            for word in item:
                state, length = self.moved(state, length, word)
                if length >= window:
                    self.full.setdefault(self.at_length(state, window), set()).add(number)
            if item and len(item) < window:
                self.short.setdefault(self.at_length(state, len(item)), []).append((len(item), number))
                self.least = min(self.least, len(item))
        # Nearest state up the suffix links that holds short items.
        self.up = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            parent = self.link[state]
            self.up[state] = parent if parent in self.short else self.up[parent] if parent > 0 else -1
        size = len(self.vocabulary)
        pairs = {a * size + b for item in coded for a, b in zip(item, item[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)

    def _extended(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, word, known)
        new = self._state(self.length[last] + 1, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            known = self.next[at][word]
            exact = self.length[known] == self.length[at] + 1
            self.link[new] = known if exact else self._split(at, word, known)
        return new

    def _split(self, at: int, word: int, known: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.next[known]))
        self.link[copy], self.link[known] = self.link[known], copy
        while at >= 0 and self.next[at].get(word) == known:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _state(self, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def moved(self, state: int, length: int, word: int) -> tuple[int, int]:
        """State and longest matching length after one more word."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.next[state].get(word)
        return (0, 0) if to is None else (to, length + 1)

    def at_length(self, state: int, length: int) -> int:
        """The state on the suffix path of ``state`` that holds its suffix of ``length`` words."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged hit spans [start, end) of ``words`` and the numbers of the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        if len(words) < self.least or not self.vocabulary:
            return spans, found
        codes = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        for start, end in self._stretches(codes):
            state = length = 0
            for at in range(start, end):
                state, length = self.moved(state, length, int(codes[at]))
                reach = 0
                if length >= self.window:
                    reach = self.window
                    found |= self.full[self.at_length(state, reach)]
                if self.short:
                    holder = state if state in self.short else self.up[state]
                    while holder > 0:
                        for size, number in self.short[holder]:
                            if size <= length:
                                reach = max(reach, size)
                                found.add(number)
                        holder = self.up[holder]
                if reach:
                    begin = at + 1 - reach
                    while spans and spans[-1][1] >= begin:
                        begin = min(begin, spans.pop()[0])
                    spans.append((begin, at + 1))
        return spans, found

    def _stretches(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """Runs of words whose neighbours are neighbours in an item too, as long as the shortest window.

        No longer match crosses a pair of words that no item holds, so the rest need not be streamed.
        """
        if self.least < 2:
            joined = (codes[:-1] >= 0) & (codes[1:] >= 0)
        else:
            pair = codes[:-1] * len(self.vocabulary) + codes[1:]
            place = np.searchsorted(self.pairs, pair)
            place[place == len(self.pairs)] = 0
            known = self.pairs[place] == pair if len(self.pairs) else np.zeros(len(pair), bool)
            joined = known & (codes[:-1] >= 0) & (codes[1:] >= 0)
        cuts = np.flatnonzero(~joined) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(codes)]])
        long = (ends - starts >= self.least) & (codes[starts] >= 0)
        return list(zip(starts[long].tolist(), ends[long].tolist()))


def item_blocks(benchmark: DataFrame, item: str, text: str, words: int) -> list[list[tuple[str | None, str]]]:
    """Items as lists of about ``words`` words each, cut by a hash of the text.

    Only lists of that size reach the driver, one automaton each; a single item is never cut.
    """
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item).cast("string"), F.col(text))
    # A word takes two bytes at least with its separator.
    total = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(1, -(-total // (2 * words)))
    if parts == 1:
        return [[tuple(r) for r in rows.collect()]]
    part = F.pmod(F.xxhash64(text), F.lit(parts))
    return ([tuple(r) for r in rows.where(part == n).collect()] for n in range(parts))


def hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    automaton_words: int = AUTOMATON_WORDS,
) -> DataFrame:
    """``docs`` with _words (their number), _spans (starts and ends in words) and _items, those whose windows occur.

    Texts stream through one automaton per block of items; there is no shuffle. With several blocks, each pass is
    written before the next, so that a task holds one automaton at a time. A null text has no
    words; a null item id counts as an item without a name; repeated rows give repeated results.
    """
    kept = docs.columns
    schema = docs.schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    out += ", _words bigint, _spans array<bigint>, _items array<string>"
    rows = docs.withColumns(
        {
            "_words": F.lit(0).cast("bigint"),
            "_spans": F.array().cast("array<bigint>"),
            "_items": F.array().cast("array<string>"),
        }
    )
    first = True
    for block in item_blocks(benchmark, item, item_text, automaton_words):
        if not first:
            rows = settled(rows, "decontaminate")
        first = False
        names = docs.sparkSession.sparkContext.broadcast(block)

        def scan(batches, names=names):
            items = names.value
            machine = SuffixAutomaton([plain_words(t.encode()) for _, t in items], window)
            for whole in batches:
                for batch in slices(whole, text):
                    counts, spans, found = [], [], []
                    old_spans, old_items = batch.column("_spans").to_pylist(), batch.column("_items").to_pylist()
                    for i, data in enumerate(as_bytes(batch.column(text))):
                        words = plain_words(data)
                        new, numbers = machine.scan(words)
                        counts.append(len(words))
                        spans.append(_joined(old_spans[i], new))
                        found.append(sorted({*old_items[i], *[items[n][0] for n in numbers]}, key=lambda x: x or ""))
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[batch.column(c) for c in kept],
                            pa.array(counts, pa.int64()),
                            pa.array(spans, pa.list_(pa.int64())),
                            pa.array(found, pa.list_(pa.string())),
                        ],
                        names=[*kept, "_words", "_spans", "_items"],
                    )

        rows = rows.mapInArrow(scan, out)
    return rows


def _joined(flat: list[int], new: list[tuple[int, int]]) -> list[int]:
    """Union of sorted spans, as a flat list of starts and ends."""
    spans = sorted([*zip(flat[::2], flat[1::2]), *new])
    out: list[int] = []
    for start, end in spans:
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", share: int = 20, **options
) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) for every row.

    Contaminated: some word is hit, and ``share`` times the hit words reach the words. ``items_sha256`` is over the
    sorted, comma-joined ids of the items whose windows occur. Texts do not leave the tasks that read them.
    """
    found = hits(docs.select(key, text), benchmark, text=text, **options)
    return found.select(
        key,
        F.col("_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.filter("_items", F.isnotnull)), ","), 256).alias("items_sha256"),
        contaminated(share).alias("contaminated"),
    )


def n_hit():
    """Words inside spans: ends minus starts."""
    return F.aggregate(
        F.transform("_spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )


def contaminated(share: int):
    return (n_hit() > 0) & (F.lit(share) * n_hit() >= F.col("_words"))


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", share: int = 20, cut: bool = False, **options
) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns, whatever their names.

    With ``cut``, spans below the coverage limit are cut out of the texts that stay, from their first
    word to their last; without it those texts stay as they are. Null and empty texts have no words and stay; repeated rows
    are judged alike; without items every row stays; an empty table gives no rows.
    """
    rows = packed(docs, text)
    clean = hits(rows, benchmark, text="_text", **options).where(~contaminated(share))
    if cut:
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

        def trim(batches):
            for whole in batches:
                for batch in slices(whole, "_text"):
                    spans = batch.column("_spans").to_pylist()
                    texts = [without_spans(t, s) for t, s in zip(batch.column("_text").to_pylist(), spans)]
                    yield pa.RecordBatch.from_arrays([batch.column("_packed"), pa.array(texts, pa.string())], names=["_packed", "_text"])

        clean = clean.select("_packed", "_text", "_spans").mapInArrow(trim, schema)
    return clean.select(*unpacked(docs.columns, text))


def without_spans(text: str | None, spans: list[int]) -> str | None:
    """``text`` without the characters from the first to the last word of each span."""
    if not text or not spans:
        return text
    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    pieces, at = [], 0
    for start, end in zip(spans[::2], spans[1::2]):
        pieces.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return "".join([*pieces, text[at:]])
