"""The same results in SQL, for the operators that SQL can express."""

from __future__ import annotations

from specmill.llm.urlfilter import BLOCK_GLOBS, RULES

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all(" + LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
win AS (
  SELECT item_id, least(13, len(w)) AS m,
         unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2),
                lambda i: array_to_string(w[i : i + least(13, len(w)) - 1], ' '))) AS g
  FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT m FROM win),
grams AS (
  SELECT r, m, i, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT r, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
found AS (SELECT r, grams.m, i, item_id FROM grams JOIN win ON grams.g = win.g AND grams.m = win.m),
hit AS (
  SELECT r, count(DISTINCT p) AS n FROM (
    SELECT r, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT r, m, i FROM found)) GROUP BY r),
items AS (
  SELECT r, count(*) AS n, array_to_string(list(item_id ORDER BY item_id), ',') AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""


def _regex(glob: str) -> str:
    out, at = "", 0
    while at < len(glob):
        if glob[at : at + 2] == "**":
            out, at = out + ".*", at + 2
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(glob[at], "[" + glob[at] + "]")
        at += 1
    return out


def op5() -> str:
    rules = sorted(RULES, key=lambda r: -len(r.name))
    cases = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'"
        for r in rules
    )
    verdicts = " ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in rules)
    globs = " ".join(
        f"WHEN rule IS NULL AND regexp_full_match('.' || host || path, '{_regex(g)}', 's') THEN '{g}'"
        for g in BLOCK_GLOBS
    )
    return f"""
WITH parts AS (
  SELECT page_id,
         {LOWER.format("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
ruled AS (SELECT *, CASE {cases} END AS rule FROM parts),
globbed AS (SELECT *, CASE {globs} END AS matched_glob FROM ruled)
SELECT page_id, host, path, rule,
       CASE {verdicts} WHEN matched_glob IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, matched_glob
FROM globbed
"""


OP3 = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1),
                              lambda i: array_to_string(w[i : i + 2], ' '))
                            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
shared AS (SELECT a.r AS x, b.r AS y, count(*) AS m FROM s a JOIN s b USING (g) WHERE a.r <> b.r GROUP BY ALL),
links AS (
  SELECT DISTINCT dx.doc_id AS x, dy.doc_id AS y FROM shared
  JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y JOIN d dx ON dx.r = x JOIN d dy ON dy.r = y
  WHERE 100 * m >= 85 * (nx.n + ny.n - m)),
reach AS (
  SELECT DISTINCT doc_id AS x, doc_id AS y FROM d
  UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (r) JOIN least ON least.x = d.doc_id
"""

OP12 = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3),
                              lambda i: array_to_string(w[i : i + 4], ' '))
                            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
shared AS (SELECT a.r AS x, b.r AS y, count(*) AS m FROM s a JOIN s b USING (g) WHERE a.r < b.r GROUP BY ALL),
near AS (
  SELECT dx.doc_id AS x, dy.doc_id AS y FROM shared
  JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y JOIN d dx ON dx.r = x JOIN d dy ON dy.r = y
  WHERE 100 * m >= 80 * (nx.n + ny.n - m)),
links AS (SELECT x, y FROM near UNION SELECT y, x FROM near),
reach AS (
  SELECT DISTINCT doc_id AS x, doc_id AS y FROM d
  UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id
FROM d LEFT JOIN n USING (r) LEFT JOIN least ON least.x = d.doc_id
"""

# The pages given have one <article> each, of headings and paragraphs.
OP4 = r"""
WITH inner_html AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS h FROM pages),
marked AS (
  SELECT page_id, url,
         regexp_replace(regexp_replace(regexp_replace(h, '<br>', ' ', 'g'), '</?(?:p|h1)>', chr(1), 'g'), '<[^>]*>', '', 'g') AS h
  FROM inner_html),
plain AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '&quot;?', '"', 'g'),
         '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS h FROM marked),
blocks AS (
  SELECT page_id, url, list_filter(list_transform(string_split(h, chr(1)),
         lambda b: trim(regexp_replace(b, '\s+', ' ', 'g'))), lambda b: b <> '') AS b FROM plain)
SELECT page_id, url, array_to_string(b, ' ') AS text, CAST(length(array_to_string(b, ' ')) AS BIGINT) AS n_chars FROM blocks
"""


# Levels of a tree of at most 16 million leaves, and of as many trees.
MERKLE_LEVELS = 24


def _field(name: str) -> str:
    return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || CAST({name} AS VARCHAR), '-')"


def _merkle(leaves: str, prefix: str) -> str:
    """CTEs: nodes {prefix}0.. (t, i, h) level by level, and {prefix}path (t, i, path) of the leaves' proofs, entry by entry."""
    steps = [f"{prefix}0 AS ({leaves})"]
    for level in range(MERKLE_LEVELS):
        below, above = f"{prefix}{level}", f"{prefix}{level + 1}"
        steps.append(f"""{above} AS (
  SELECT t, i // 2 AS i, CASE WHEN max(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
  FROM (SELECT *, count(*) OVER (PARTITION BY t) AS n FROM {below}) GROUP BY t, i // 2)""")
    siblings = " UNION ALL ".join(
        f"SELECT t, i, h, count(*) OVER (PARTITION BY t) AS n, {level} AS level FROM {prefix}{level}"
        for level in range(MERKLE_LEVELS)
    )
    steps.append(f"{prefix}all AS ({siblings})")
    steps.append(f"""{prefix}path AS (
  SELECT l.t, l.i, list(CASE WHEN s.h IS NULL THEN 'N' WHEN s.i % 2 = 1 THEN 'R' || s.h ELSE 'L' || s.h END ORDER BY own.level)
         FILTER (own.n > 1) AS path
  FROM {prefix}0 l JOIN {prefix}all own ON own.t = l.t AND own.i = l.i >> own.level
  LEFT JOIN {prefix}all s ON s.t = own.t AND s.level = own.level AND s.i = xor(own.i, 1) GROUP BY l.t, l.i)""")
    return ",\n".join(steps)


_CRC = """xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(k) + 1), lambda p: ascii(k[p]))),
       lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]),
                                lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

_COUNTED = "coalesce(strlen(CAST(CAST(n_chars AS HUGEINT) + 1 AS VARCHAR)) || ':' || CAST(CAST(n_chars AS HUGEINT) + 1 AS VARCHAR), '-')"

OP11 = f"""
WITH d AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS t,
         sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', 'text'))}) AS leaf,
         sha256({' || '.join(_COUNTED if c == 'n_chars' else _field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', 'text'))}) AS changed,
         CAST(doc_id AS VARCHAR) AS k
  FROM documents),
shown AS (
  SELECT doc_id, t, leaf, CASE WHEN {_CRC} % 7 = 0 THEN changed ELSE leaf END AS shown,
         row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
  FROM d),
{_merkle("SELECT t, i, leaf AS h FROM shown", "a")},
tops AS (SELECT t AS name, h, row_number() OVER (ORDER BY t) - 1 AS i FROM a{MERKLE_LEVELS}),
{_merkle("SELECT '' AS t, i, h FROM tops", "b")},
proofs AS (
  SELECT s.doc_id, s.leaf, s.shown, tops.h AS subroot, (SELECT h FROM b{MERKLE_LEVELS}) AS root,
         list_concat(coalesce(ap.path, []), coalesce(bp.path, [])) AS path
  FROM shown s JOIN tops ON tops.name = s.t JOIN apath ap ON ap.t = s.t AND ap.i = s.i JOIN bpath bp ON bp.i = tops.i),
folds AS (
  SELECT *, sha256(array_to_string(list_transform(path, lambda e: e[2:]), '')) AS proof_sha256,
         list_reduce(list_concat([shown], path), lambda h, e:
           CASE e[1] WHEN 'L' THEN sha256(e[2:] || h) WHEN 'R' THEN sha256(h || e[2:]) ELSE sha256(h) END) AS folded_root
  FROM proofs)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folds
"""


def llm_oracle() -> dict[str, str]:
    return {
        "op1_decontaminate": OP1,
        "op3_near_duplicates": OP3,
        "op4_html_text": OP4,
        "op5_url_filter": op5(),
        "op11_merkle_manifest": OP11,
        "op12_jaccard_join": OP12,
    }
