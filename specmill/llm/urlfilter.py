"""URL filters: all glob rules run as one bit-parallel wildcard automaton.

Every rule becomes a run of bits, one for each of its symbols and one for its start. All runs are
packed into 64-bit words; one shift, two masks per byte of the URL move every rule at once,
and a batch of URLs moves together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmill.llm.common import as_bytes, slices

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class HostRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (
    HostRule("allow", "com", "/"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)

# What the registered query blocks where no rule fits; the subject is "." + host + path.
BLOCK_GLOBS = (
    "*adult-**",
    "*ads-track**",
    "*casino**",
    "*cheap-pills**",
    "*free-bets**",
    "*payday-loan**",
    "*spam-**",
    "*viagra**",
    "*.xxx",
    "*.xxx/**",
    "**.exe",
    "**.zip",
    "**/wp-login.php",
)

ANY, IN_PART = range(256), [b for b in range(256) if b != ord("/")]


def glob_symbols(glob: str) -> list[tuple[str, int]]:
    """("byte", b), ("one", 0) for ``?``, ("part", 0) for ``*`` and ("all", 0) for ``**``."""
    out, data, at = [], glob.encode(), 0
    while at < len(data):
        if data[at : at + 2] == b"**":
            out.append(("all", 0))
            at += 2
            continue
        byte = data[at]
        out.append(("part", 0) if byte == ord("*") else ("one", 0) if byte == ord("?") else ("byte", byte))
        at += 1
    return out


def rule_symbols(rule: HostRule) -> list[tuple[str, int]]:
    """A host rule as a glob over "." + host + path; its own characters are all literal."""
    literal = f".{rule.host}{rule.path}".encode()
    return [("part", 0), *[("byte", b) for b in literal], ("all", 0)]


class ShiftAnd:
    """All patterns as one automaton. ``*`` stays within a part of the URL, ``**`` crosses "/"."""

    def __init__(self, patterns: list[list[tuple[str, int]]]):
        size = sum(1 + sum(kind in ("byte", "one") for kind, _ in p) for p in patterns)
        self.words = max(1, -(-size // 64))
        step = np.zeros((256, self.words * 64), bool)
        stay = np.zeros((256, self.words * 64), bool)
        starts = np.zeros(self.words * 64, bool)
        self.final = np.zeros(len(patterns), np.int64)
        bit = 0
        for i, pattern in enumerate(patterns):
            starts[bit] = True
            for kind, byte in pattern:
                if kind == "part":
                    stay[IN_PART, bit] = True
                elif kind == "all":
                    stay[:, bit] = True
                else:
                    bit += 1
                    step[[byte] if kind == "byte" else IN_PART, bit] = True
            self.final[i] = bit
            bit += 1
        self.step, self.stay, self.start = _packed(step), _packed(stay), _packed(starts[None])[0]

    def matches(self, subjects: list[bytes]) -> np.ndarray:
        """bool[subject, pattern]: whether the pattern fits the whole subject."""
        lengths = np.array([len(s) for s in subjects], np.int64)
        flat = np.frombuffer(b"".join(subjects), np.uint8)
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if subjects else lengths
        order = np.argsort(-lengths, kind="stable")
        begins, longest = begins[order], lengths[order]
        state = np.tile(self.start, (len(subjects), 1))
        one, top = np.uint64(1), np.uint64(63)
        for at in range(int(longest[0]) if len(longest) else 0):
            live = int(np.searchsorted(-longest, -at, side="left"))  # subjects with a byte here
            now = state[:live]
            byte = flat[begins[:live] + at]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = (moved & self.step[byte]) | (now & self.stay[byte])
        found = np.zeros((len(subjects), len(self.final)), bool)
        found[order] = (state[:, self.final // 64] >> (self.final % 64).astype(np.uint64)) & one
        return found


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def judged_urls(
    pages: DataFrame,
    rules: tuple[HostRule, ...] = RULES,
    block_globs: tuple[str, ...] = BLOCK_GLOBS,
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """(key, host, path, rule, verdict, matched_glob) for every row.

    Of the rules that fit, the longest decides (ties: longer host, then block); without one, the first of
    ``block_globs`` that fits blocks and is named in ``matched_glob``; everything else is allowed. A null
    URL or one without ``://`` has an empty host and path and meets the globs only. Repeated
    rows give repeated results; other columns of ``pages`` are not read. The patterns run over UTF-8 bytes.
    """
    ranked = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.verdict != "block"))
    machine = ShiftAnd([rule_symbols(r) for r in ranked] + [glob_symbols(g) for g in block_globs])
    names = [r.name for r in ranked] + [None]
    verdicts = [r.verdict for r in ranked]
    globs = [*block_globs, None]

    def judge(batches):
        for whole in batches:
            for batch in slices(whole, "_subject"):
                found = machine.matches(as_bytes(batch.column("_subject")))
                by_rule = np.argmax(np.c_[found[:, : len(ranked)], np.ones(len(found), bool)], axis=1)
                by_glob = np.argmax(np.c_[found[:, len(ranked) :], np.ones(len(found), bool)], axis=1)
                by_glob[by_rule < len(ranked)] = len(block_globs)
                verdict = [
                    verdicts[r] if r < len(ranked) else "block" if g < len(block_globs) else "allow"
                    for r, g in zip(by_rule, by_glob)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(key),
                        batch.column("host"),
                        batch.column("path"),
                        pa.array([names[r] for r in by_rule], pa.string()),
                        pa.array(verdict, pa.string()),
                        pa.array([globs[g] for g in by_glob], pa.string()),
                    ],
                    names=[key, "host", "path", "rule", "verdict", "matched_glob"],
                )

    host = F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)
    parts = pages.select(
        F.col(key), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path")
    ).withColumn("_subject", F.concat(F.lit("."), "host", "path"))
    kind = parts.schema[key].dataType.simpleString()
    return parts.mapInArrow(
        judge, f"`{key}` {kind}, host string, path string, rule string, verdict string, matched_glob string"
    )
