"""Pseudonyms for personal data that keep its format: keyed Feistel permutations inside each value's own format.

Card and identity numbers, phone numbers, addresses of the network, dates, mail names and secrets are found by
pattern, validated, and replaced by the image of a keyed permutation of all values of the same format. Equal
values get equal pseudonyms in all documents, different values different ones. Everything is
built from SQL functions; no Python runs on rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmill.functions.once import evaluated_once
from specmill.llm.common import packed, unpacked

DEFAULT_KEY = "set-your-own-key"
ROUNDS = 8
# Characters of a long value that are permuted together.
BLOCK = 64

# A domain has 127 labels at most; Java's matcher takes some stack for each of them.
MAIL = r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,126}(?<=\.[A-Za-z]{2,24})"
# A separator before or after a value makes it part of something longer only where a digit stands beyond it.
DATE = r"(?<!\d)(?<!\d[/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?!\d|[/-]\d)"
ADDRESS = r"(?<!\d)(?<!\d\.)(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
CARD = r"(?<!\d)(?<!\d[.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d|-\d)"
IDENTITY = r"(?<!\d)(?<!\d-)\d{3}-\d{2}-\d{4}(?!\d|-\d)"
PHONE = (
    r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)"
    r"|(?<![\d(+])(?<!\d-)\(\d{3}\) ?\d{3}[ .-]?\d{4}(?!\d)"
    r"|(?<!\d)(?<!\d[.-])\d{3}[.-]\d{3}[.-]\d{4}(?!\d|-\d)"
)
SECRET = (
    r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
    r"|(?<![A-Za-z])(?i:password|passwd|pwd|token|secret|api[_-]?key) ?[=:] ?[\"']?[A-Za-z0-9_+/-]{8,}"
)
# Earlier kinds win where two could begin at the same place.
KINDS = (
    ("mail", MAIL),
    ("secret", SECRET),
    ("date", DATE),
    ("address", ADDRESS),
    ("card", CARD),
    ("identity", IDENTITY),
    ("phone", PHONE),
)
ANY = "|".join(f"(?:{pattern})" for _, pattern in KINDS)
# Every match of ANY holds one of these; a cheap look before the long pattern.
HINT = r"[@0-9]|AKIA|(?i:password|passwd|pwd|token|secret|key)"

# Alphabets by mask letter; other mask letters keep the character.
ALPHABETS = {
    "d": "0123456789",
    "n": "23456789",
    "h": "0123456789abcdef",
    "a": "abcdefghijklmnopqrstuvwxyz",
    "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
}


def _text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digest(key: str, *parts: str) -> str:
    return f"sha2(concat_ws('|', {_text(key)}, {', '.join(parts)}), 256)"


def _shifted(text: str, mask: str, digest: str) -> str:
    """Each character moved in its alphabet by an amount read from the digest; others stay."""
    cases = " ".join(
        f"WHEN substr({mask}, i, 1) = '{letter}' AND instr('{symbols}', substr({text}, i, 1)) > 0 "
        f"THEN substr('{symbols}', cast(pmod(instr('{symbols}', substr({text}, i, 1)) - 1 "
        f"+ cast(conv(substr({digest}, 1 + (2 * i) % 60, 4), 16, 10) AS int), {len(symbols)}) + 1 AS int), 1)"
        for letter, symbols in ALPHABETS.items()
    )
    moved = f"transform(sequence(1, length({text})), i -> CASE {cases} ELSE substr({text}, i, 1) END)"
    return f"if(length({text}) = 0, '', array_join({moved}, ''))"


def characters(value: str, mask: str, key: str) -> str:
    """Values of any length in blocks, each of them permuted under its place and the block before it, as that was.

    From the first block on every block can be undone, so the whole is one to one; work grows with the length. A value
    of one block depends on its own characters only.
    """

    def cut(text: str) -> str:
        return f"regexp_extract_all({text}, '(?s).{{1,{BLOCK}}}', 0)"

    tweak = f"if(n = 0, '', concat_ws('|', n, length({value}), get(w.b, n - 1)))"
    moved = _network("z.b", "z.m", "z.t", key)
    blocks = f"transform(w.b, (b, n) -> named_struct('b', b, 'm', get(w.m, n), 't', {tweak}))"
    whole = f"array(named_struct('b', {cut(value)}, 'm', {cut(mask)}))"
    return f"get(transform({whole}, w -> array_join(transform({blocks}, z -> {moved}), '')), 0)"


def _network(value: str, mask: str, tweak: str, key: str) -> str:
    """A Feistel network over the two halves of a string.

    In turn, each half is shifted by amounts hashed from the other, which can be undone whatever the hash:
    same length, same alphabets, one to one.
    """
    half = f"cast(length({value}) / 2 AS int)"
    left = _shifted("s.l", f"substr({mask}, 1, {half})", "s.g")
    right = _shifted("s.r", f"substr({mask}, {half} + 1)", "s.g")
    # A round is two steps: the first hashes one half, the second shifts the other by that digest.
    keyed = _digest(key, "'text'", f"concat(length({value}), {tweak})", "j div 2", "if(j % 4 = 0, s.r, s.l)")
    start = f"named_struct('l', substr({value}, 1, {half}), 'r', substr({value}, {half} + 1), 'g', '')"
    return (
        f"aggregate(sequence(0, {2 * ROUNDS - 1}), {start}, (s, j) -> CASE "
        f"WHEN j % 2 = 0 THEN named_struct('l', s.l, 'r', s.r, 'g', {keyed}) "
        f"WHEN j % 4 = 1 THEN named_struct('l', {left}, 'r', s.r, 'g', '') "
        f"ELSE named_struct('l', s.l, 'r', {right}, 'g', '') END, s -> concat(s.l, s.r))"
    )


def pairs(a: str, b: str, x: str, y: str, label: str, key: str) -> str:
    """The same over two numbers, x below a and y below b: a struct of the new x and y."""

    def amount(other: str) -> str:
        return f"cast(conv(substr({_digest(key, label, a, b, 'k', other)}, 1, 12), 16, 10) AS bigint)"

    start = f"named_struct('x', cast({x} AS bigint), 'y', cast({y} AS bigint))"
    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, k) -> if(k % 2 = 0, "
        f"named_struct('x', pmod(s.x + {amount('s.y')}, {a}), 'y', s.y), "
        f"named_struct('x', s.x, 'y', pmod(s.y + {amount('s.x')}, {b}))))"
    )


def _kind() -> str:
    """The kind of match ``m`` if it is valid, else an empty string."""
    digits = "regexp_replace(m, '[^0-9]', '')"
    octets = "forall(split(m, '[.]'), o -> cast(o AS int) <= 255)"
    identity = "substr(m, 1, 3) NOT IN ('000', '666') AND substr(m, 1, 1) < '9' AND substr(m, 5, 2) > '00' AND right(m, 4) > '0000'"
    valid = {
        "mail": "true",
        "secret": "true",
        "date": f"{_day('m')} IS NOT NULL",
        "address": octets,
        "card": f"luhn_check({digits})",
        "identity": identity,
        "phone": f"length({digits}) BETWEEN 7 AND 15",
    }
    cases = " ".join(f"WHEN m RLIKE {_text(f'^(?:{p})$')} AND {valid[k]} THEN '{k}'" for k, p in KINDS)
    return f"CASE {cases} ELSE '' END"


def _style(m: str) -> str:
    """Date format of ``m``; a slashed date is month first unless that is no date."""
    month_first = f"to_date(try_to_timestamp({m}, 'MM/dd/yyyy')) IS NOT NULL"
    return (
        f"CASE WHEN {m} LIKE '____-%' THEN 'yyyy-MM-dd' WHEN {m} LIKE '%.%' THEN 'dd.MM.yyyy' "
        f"WHEN {month_first} THEN 'MM/dd/yyyy' ELSE 'dd/MM/yyyy' END"
    )


def _day(m: str) -> str:
    return f"to_date(try_to_timestamp({m}, {_style(m)}))"


def _parts() -> str:
    """What is permuted of ``x.m``: a string with its mask, or a pair of numbers with their limits."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    source = "0123456789" + letters + letters.upper()
    classes = "d" * 10 + "a" * 26 + "u" * 26
    digits = "regexp_replace(x.m, '[^0-9]', '')"
    value = (
        "CASE x.kind WHEN 'mail' THEN substring_index(x.m, '@', 1) "
        "WHEN 'secret' THEN if(x.m LIKE 'AKIA%', substr(x.m, 5), regexp_extract(x.m, '[=:] ?[\"\\']?(.*)$', 1)) "
        f"WHEN 'card' THEN concat(substr({digits}, 1, length({digits}) - 1), '0') "
        f"WHEN 'phone' THEN {digits} ELSE '' END"
    )
    mask = (
        f"CASE WHEN y.kind = 'card' THEN concat(repeat('d', length(y.v) - 1), 'x') "
        "WHEN y.kind = 'phone' AND length(y.v) = 10 AND y.m NOT LIKE '+%' THEN 'nddndddddd' "
        "WHEN y.kind = 'phone' AND length(y.v) = 11 AND y.m LIKE '+1%' THEN 'xnddndddddd' "
        "WHEN y.kind = 'phone' THEN concat('xx', repeat('d', length(y.v) - 2)) "
        "WHEN y.kind = 'secret' AND y.v RLIKE '^[0-9a-f]+$' THEN repeat('h', length(y.v)) "
        f"ELSE translate(y.v, '{source}', '{classes}') END"
    )
    century = "cast(floor((year(y.d) - 1950) / 100) AS int)"
    first = f"make_date(1950 + 100 * {century}, 1, 1)"
    long = f"datediff(make_date(2050 + 100 * {century}, 1, 1), {first}) = 36525"
    octet = "cast(split(y.m, '[.]')[{}] AS bigint)"
    area = "cast(substr(y.m, 1, 3) AS bigint)"
    numbers = (
        "CASE y.kind "
        # A century of 36525 days is 75 * 487 of them, one of 36524 is 92 * 397.
        f"WHEN 'date' THEN named_struct('a', if({long}, 75L, 92L), 'b', if({long}, 487L, 397L), "
        f"'x', datediff(y.d, {first}) div if({long}, 487L, 397L), 'y', datediff(y.d, {first}) % if({long}, 487L, 397L)) "
        f"WHEN 'address' THEN named_struct('a', 65536L, 'b', 65536L, 'x', {octet.format(0)} * 256 + {octet.format(1)}, "
        f"'y', {octet.format(2)} * 256 + {octet.format(3)}) "
        # Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999.
        f"WHEN 'identity' THEN named_struct('a', 898L, 'b', 989901L, 'x', {area} - if({area} > 666, 2, 1), "
        "'y', (cast(substr(y.m, 5, 2) AS bigint) - 1) * 9999 + cast(right(y.m, 4) AS bigint) - 1) END"
    )
    day = f"if(x.kind = 'date', {_day('x.m')}, NULL)"
    named = f"named_struct('m', x.m, 'kind', x.kind, 'v', {value}, 'd', {day}, 'style', {_style('x.m')})"
    return (
        f"transform(transform(_kinds, x -> {named}), y -> named_struct('m', y.m, 'kind', y.kind, 'v', y.v, 'mask', {mask}, "
        f"'d', y.d, 'style', y.style, 'first', if(y.kind = 'date', {first}, NULL), 'n', {numbers}))"
    )


def _moved(key: str) -> str:
    """Every value ``p`` permuted: the new string and the new pair."""
    return (
        "transform(_parts, p -> named_struct('p', p, "
        f"'v', if(length(p.v) > 0, {characters('p.v', 'p.mask', key)}, ''), "
        f"'n', if(p.n IS NULL, NULL, {pairs('p.n.a', 'p.n.b', 'p.n.x', 'p.n.y', 'p.kind', key)})))"
    )


def _written() -> str:
    """Every value in the format it came in."""
    # Luhn's check digit over all digits but the last.
    doubled = "cast(substr(q.v, i, 1) AS int) * 2 - if(substr(q.v, i, 1) > '4', 9, 0)"
    total = (
        "aggregate(transform(sequence(1, length(q.v) - 1), i -> if((length(q.v) - i) % 2 = 1, "
        f"{doubled}, cast(substr(q.v, i, 1) AS int))), 0, (s, e) -> s + e)"
    )
    card = f"concat(substr(q.v, 1, length(q.v) - 1), cast((10 - {total} % 10) % 10 AS string))"

    def in_place(digits: str) -> str:
        return (
            "array_join(transform(sequence(1, length(q.p.m)), i -> if(substr(q.p.m, i, 1) BETWEEN '0' AND '9', "
            f"substr({digits}, length(regexp_replace(substr(q.p.m, 1, i), '[^0-9]', '')), 1), substr(q.p.m, i, 1))), '')"
        )

    area = "q.n.x + if(q.n.x + 1 >= 666, 2, 1)"
    return (
        "transform(_moved, q -> CASE q.p.kind "
        "WHEN 'mail' THEN concat(q.v, substr(q.p.m, length(q.v) + 1)) "
        "WHEN 'secret' THEN concat(substr(q.p.m, 1, length(q.p.m) - length(q.v)), q.v) "
        f"WHEN 'card' THEN {in_place('(' + card + ')')} "
        f"WHEN 'phone' THEN {in_place('q.v')} "
        "WHEN 'date' THEN date_format(date_add(q.p.first, cast(q.n.x * q.p.n.b + q.n.y AS int)), q.p.style) "
        "WHEN 'address' THEN concat_ws('.', q.n.x div 256, q.n.x % 256, q.n.y div 256, q.n.y % 256) "
        f"WHEN 'identity' THEN concat_ws('-', lpad(cast({area} AS string), 3, '0'), "
        "lpad(cast(q.n.y div 9999 + 1 AS string), 2, '0'), lpad(cast(q.n.y % 9999 + 1 AS string), 4, '0')) "
        "ELSE q.p.m END)"
    )


def pseudonymised(
    docs: DataFrame, text: str = "text", key: str = DEFAULT_KEY, counts: bool = True
) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and with ``counts`` n_mail, n_secret, n_date, n_address, n_card, n_identity, n_phone.

    Validated are: cards (Luhn; the pseudonym's check digit is right too), identity numbers (areas, groups and serials in
    use), addresses (octets), dates (calendar; the pseudonym is in the same hundred years) and phone numbers (length; North American
    ones keep valid first digits). Mail domains, country code and the names before secrets stay. Anything that only
    looks alike, and every other character, stays as it is. Numbers link whatever their separators are.

    A null text stays null with counts of 0, an empty one empty; repeated rows get the same result; an empty table
    gives no rows. Other columns are handed on, whatever their names; with ``counts``, input columns named like a count are
    replaced.
    """
    kinds = [k for k, _ in KINDS]
    kept = [c for c in docs.columns if not counts or c not in {f"n_{k}" for k in kinds}]
    held = ["_packed", "_text"]
    found = F.when(F.col("_text").rlike(HINT), F.regexp_extract_all("_text", F.lit(ANY), F.lit(0)))
    rows = evaluated_once(packed(docs.select(*[f"`{c}`" for c in kept]), text), held, {"_matches": found.otherwise(F.array().cast("array<string>"))})
    rows = rows.select(*held, F.expr(f"transform(_matches, m -> named_struct('m', m, 'kind', {_kind()}))").alias("_kinds"))
    rows = rows.select(*held, "_kinds", F.expr(_parts()).alias("_parts"))
    rows = rows.select(*held, "_kinds", F.expr(_moved(key)).alias("_moved"))
    rows = evaluated_once(
        rows,
        held,
        {"_new": F.expr(_written()), **{f"n_{k}": F.expr(f"cast(size(filter(_kinds, k -> k.kind = '{k}')) AS bigint)") for k in kinds}},
    )
    pieces = F.split(F.col("_text"), ANY, -1)
    woven = F.array_join(
        F.transform(pieces, lambda piece, i: F.concat(piece, F.coalesce(F.get("_new", i), F.lit("")))),
        "",
    )
    new = F.when(F.size("_new") > 0, woven).otherwise(F.col("_text"))
    return rows.select(*unpacked(kept, text, new), *([f"n_{k}" for k in kinds] if counts else []))
