"""Main text of web pages by tag-path ratios.

A page becomes a list of text blocks, each with its path of block tags from the root. Text length and punctuation are
added up per path, smoothed along the page, fused, and compared with a threshold of the page's own spread:
paths above it carry content. The element that holds nearly all of that content is the article; content and
headings beside it belong to it too, unless an article or main element says where the article ends. Names and wrappers
that usually mark something else give way to an article below them; inside an article the text's own score decides.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmill.llm.common import slices

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?", re.S)
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…。，！？；：、¿¡]")
COPYRIGHT = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)
NAME_PARTS = re.compile(r"[^0-9a-z]+")

RAW = frozenset("script style textarea title xmp noscript template iframe noembed noframes".split())
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I | re.A) for name in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html head body address article aside blockquote button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup legend li main map menu nav object ol "
    "optgroup option p pre section select summary svg table tbody td tfoot th thead tr ul video audio canvas".split()
)
# What a new element closes first, up to the boundary in the second set.
LIST, TABLE = frozenset(("ul", "ol", "menu", "dir")), frozenset(("table",))
CLOSES = {
    "li": (frozenset(("li",)), LIST),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select",))),
    "tr": (frozenset(("tr", "td", "th")), TABLE),
    "td": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "th": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "body": (frozenset(("head",)), frozenset(("html",))),
}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"))
ARTICLE = frozenset(("article", "main"))
# Elements, roles and parts of class and id names that mark something other than the article.
NOT_ARTICLE = frozenset(
    "head nav aside footer button select option svg canvas dialog menu audio video map".split()
)
# Not the article either, but some pages stand in one as a whole.
WRAPPERS = frozenset("form fieldset object".split())
NOT_ARTICLE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu".split())
NOT_ARTICLE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion nav navbar navigation menu "
    "sidebar aside cookie cookies consent gdpr banner notice notices alert comment comments disqus reply replies "
    "respond newsletter subscribe signup login share sharing social related recommended recommendations breadcrumb "
    "breadcrumbs pagination pager popup modal overlay search widget toolbar copyright footer".split()
)
# Such names mark other people's texts, which may be longer than the article.
OTHER_TEXTS = frozenset("comment comments disqus reply replies respond related recommended recommendations".split())
# Inside an article these may be its subject: there the text decides.
DOUBTFUL_NAMES = frozenset(
    "promo promotion notice notices alert banner search social share sharing signup login widget copyright".split()
)
# Words that say how an element is laid out, not what it holds: inside an article, a name of others too is another name.
FRAME_NAMES = frozenset(
    "box bar block section container wrapper wrap list area form link links button buttons icon icons item items panel top "
    "bottom left right inner outer post posts article articles header title text body unit slot card thread count meta".split()
)
# Site headers go, but an article may have a header of its own.
OUTSIDE_ARTICLE_NAMES = frozenset(("header", "masthead", "topbar"))

SMOOTHING = 2
SHARE = 0.8
THRESHOLD = 0.5
# A paragraph of so many characters outside links, with punctuation, is no label of a form.
PROSE = 80


class Page:
    """Elements and text blocks of one page. Elements are numbers; 0 is the root."""

    def __init__(self, source: str):
        self.tag, self.parent, self.path, self.out, self.within = ["#root"], [-1], [0], [False], [False]
        # Marks of an element itself: surely not the article; not the article by a part of its name; other texts by name.
        self.hard, self.named, self.other = [False], [False], [False]
        # Marked as a wrapper; by a name that means little inside an article, and the next such element above or 0.
        self.wraps, self.doubtful, self.doubt = [False], [False], [0]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters inside links
        self._paths: dict[tuple[int, str], int] = {}
        self._pieces: list[tuple[str, bool]] = []
        self._read(source)
        self._resolve()

    def _read(self, source: str) -> None:
        stack, links, at = [0], 0, 0
        while True:
            match = TOKEN.search(source, at)
            # A "<" that opens nothing is text.
            if match is None:
                self._pieces.append((source[at:], links > 0))
                break
            if match.start() > at:
                self._pieces.append((source[at : match.start()], links > 0))
            at = match.end()
            name = match.group(2)
            if name is None:
                continue
            name, closing = name.lower(), match.group(1)
            if name in RAW:
                if not closing and not match.group(3).endswith("/"):
                    end = RAW_END[name].search(source, at)
                    at = end.start() if end else len(source)
                continue
            if name == "br" or name == "hr":
                self._pieces.append((" ", False))
            if name == "a":
                links = 0 if closing else 1
            if name not in BLOCK:
                continue
            self._flush(stack[-1])
            if closing:
                links = 0
                self._close(stack, name)
                continue
            self._open(stack, name, match.group(3))
        self._flush(stack[-1])

    def _close(self, stack: list[int], name: str) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if self.tag[stack[depth]] == name:
                del stack[depth:]
                return

    def _open(self, stack: list[int], name: str, attributes: str) -> None:
        if self.tag[stack[-1]] == "p" or (self.tag[stack[-1]] in HEADINGS and name in HEADINGS):
            stack.pop()
        closed, boundary = CLOSES.get(name, (frozenset(), frozenset()))
        if closed:
            for depth in range(len(stack) - 1, 0, -1):
                if self.tag[stack[depth]] in boundary:
                    break
                if self.tag[stack[depth]] in closed:
                    del stack[depth:]
                    if name != "tr":
                        break
        above, hard, named, other, doubtful = stack[-1], False, False, False, False
        within = self.within[above] or name in ARTICLE
        if attributes:
            found = {k.lower(): (a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(attributes)}
            names = f"{found.get('class', '')} {found.get('id', '')}".lower()
            parts = set(NAME_PARTS.split(names))
            marks = set() if name in ("html", "body", "article", "main") else marking_names(names, self.within[above])
            style = found.get("style", "").replace(" ", "").lower()
            within = within or found.get("role") == "main"
            doubtful = self.within[above] and bool(marks) and marks <= DOUBTFUL_NAMES
            named = bool(marks and not doubtful) or bool(
                parts & OUTSIDE_ARTICLE_NAMES and not within and name not in ("html", "body")
            )
            other = named and bool(marks & OTHER_TEXTS)
            hard = (
                found.get("role", "").lower() in NOT_ARTICLE_ROLES
                or "hidden" in found
                or found.get("aria-hidden") == "true"
                or "display:none" in style
            )
        hard = hard or name in NOT_ARTICLE or (name == "header" and not within)
        self.tag.append(name)
        self.parent.append(above)
        label = f"{name} {found.get('class', '')}" if attributes else name
        self.path.append(self._paths.setdefault((self.path[above], label), len(self._paths) + 1))
        self.out.append(False)
        self.hard.append(hard)
        self.named.append(named or name in WRAPPERS)
        self.other.append(other)
        self.wraps.append(name in WRAPPERS)
        self.doubtful.append(doubtful)
        self.doubt.append(len(self.doubt) if doubtful else self.doubt[above])
        self.within.append(within)
        if name not in VOID:
            stack.append(len(self.tag) - 1)

    def _resolve(self) -> None:
        """Sets what is outside the article: all below a mark, but a mark by name goes where the main text is below it.

        That is so if an article or main element below it is longer than all text without a mark, or its own text is,
        unless the name says that it is others' or an article or main element without a mark has text. A form
        and the like give way in the same cases, but of their own text only paragraphs of prose count.
        """
        own, prose = [0] * len(self.tag), [0] * len(self.tag)
        for element, text, linked in self.blocks:
            length = max(0, len(text) - linked)
            own[element] += length
            if self.tag[element] == "p" and length >= PROSE and PUNCTUATION.search(text):
                prose[element] += length
        while True:
            self.out = [False] * len(self.tag)
            sure = [False] * len(self.tag)
            others = [False] * len(self.tag)
            for e in range(1, len(self.tag)):
                above = self.parent[e]
                sure[e] = sure[above] or self.hard[e]
                others[e] = others[above] or (self.named[e] and self.other[e])
                self.out[e] = self.out[above] or self.hard[e] or self.named[e]
            if not any(self.named):
                return
            clear = sum(n for n, out in zip(own, self.out) if not out)
            told = any(n and within and not out for n, within, out in zip(own, self.within, self.out))
            # Text of an element without what is below a mark inside it.
            text, told_in_prose = own[:], prose[:]
            for e in range(len(self.tag) - 1, 0, -1):
                if not (self.hard[e] or self.named[e]):
                    text[self.parent[e]] += text[e]
                    told_in_prose[self.parent[e]] += told_in_prose[e]
                elif self.wraps[e]:
                    text[e] = told_in_prose[e]
            most, longest = clear, 0
            for e in range(1, len(self.tag)):
                if not self.out[e] or sure[e] or text[e] <= most:
                    continue
                if self.tag[e] in ARTICLE or (self.named[e] and not others[e] and not told):
                    most, longest = text[e], e
            if not longest:
                return
            while longest > 0:
                self.named[longest] = False
                longest = self.parent[longest]

    def _flush(self, element: int) -> None:
        pieces, self._pieces = self._pieces, []
        if not pieces:
            return
        text = SPACE.sub(" ", html.unescape("".join(p for p, _ in pieces))).strip()
        if text:
            linked = sum(len(SPACE.sub(" ", p).strip()) for p, link in pieces if link)
            self.blocks.append((element, text, linked))


def marking_names(names: str, inside: bool) -> set[str]:
    """Parts of class and id ``names`` that mark something else; inside an article, of names that say nothing else."""
    found = set()
    for name in names.split():
        parts = {p for p in NAME_PARTS.split(name) if p and not p.isdigit()}
        if not inside or parts <= NOT_ARTICLE_NAMES | FRAME_NAMES:
            found |= parts & NOT_ARTICLE_NAMES
    return found


def path_scores(page: Page) -> list[float]:
    """For each block, the fused and smoothed text and punctuation ratios of its path."""
    length: dict[int, list[float]] = {}
    for element, text, linked in page.blocks:
        sums = length.setdefault(page.path[element], [0, 0, 0])
        sums[0] += 1
        sums[1] += max(0, len(text) - linked)
        sums[2] += len(PUNCTUATION.findall(text)) if linked * 2 < len(text) else 0
    kernel = [math.exp(-(d * d) / 2) for d in range(-SMOOTHING, SMOOTHING + 1)]
    raw = []
    for element, _, _ in page.blocks:
        nodes, chars, marks = length[page.path[element]]
        raw.append((chars / nodes, marks / nodes))
    scores = []
    for i in range(len(raw)):
        reach = [(raw[j], kernel[j - i + SMOOTHING]) for j in range(max(0, i - SMOOTHING), min(len(raw), i + SMOOTHING + 1))]
        weight = sum(k for _, k in reach)
        text = sum(r[0] * k for r, k in reach) / weight
        marks = sum(r[1] * k for r, k in reach) / weight
        # A path's own ratios count as much as its neighbourhood's.
        scores.append(math.sqrt(raw[i][0] * text) * (1 + math.sqrt(raw[i][1] * marks)))
    return scores


def main_text(source: str | None) -> str:
    """The article of a page: its blocks in page order, joined by one space."""
    if not source:
        return ""
    page = Page(source)
    usable = [i for i, (element, _, _) in enumerate(page.blocks) if not page.out[element]]
    if not usable:
        return ""
    scores = path_scores(page)
    mean = sum(scores[i] for i in usable) / len(usable)
    spread = math.sqrt(sum((scores[i] - mean) ** 2 for i in usable) / len(usable))
    content = {i for i in usable if scores[i] >= min(THRESHOLD * spread, mean)}
    if any(page.doubtful):
        usable = _without_doubtful(page, usable, scores, content)
        content &= set(usable)
    mass = [0.0] * len(page.tag)
    for i in content:
        mass[page.blocks[i][0]] += len(page.blocks[i][1])
    best, most = list(range(len(page.tag))), [0.0] * len(page.tag)
    for element in range(len(page.tag) - 1, 0, -1):
        above = page.parent[element]
        mass[above] += mass[element]
        if mass[element] > most[above]:
            most[above], best[above] = mass[element], element
    # Down to the element that holds nearly all content; an article is not taken apart.
    at = 0
    while best[at] != at and most[at] >= SHARE * mass[0] and page.tag[best[at]] not in ("p", "pre", "td", "li"):
        at = best[at]
        if page.tag[at] == "article":
            break
    at = _with_headings(page, usable, content, at)
    inside = _below(page, at)
    told = any(page.tag[e] == "article" for e in _line(page, at))
    loose = {}
    for i in usable:
        element, text, linked = page.blocks[i]
        sums = loose.setdefault(page.path[element], [0, 0])
        sums[0] += len(text)
        sums[1] += linked
    kept = []
    for i in usable:
        element, text, _ = page.blocks[i]
        chars, linked = loose[page.path[element]]
        # What an article element holds is its author's choice: a list of links there may be its references.
        lists_links = not told and linked > 0.7 * chars and i not in content and page.tag[element] not in HEADINGS
        if inside[element] and not lists_links:
            kept.append(i)
    if not told:
        kept = _with_rest(page, usable, content, at, kept)
    return " ".join(page.blocks[i][1] for i in kept)


def _without_doubtful(page: Page, usable: list[int], scores: list[float], content: set[int]) -> list[int]:
    """``usable`` without the doubtful elements whose paths score far below the content that nothing marks."""
    plain = [scores[i] for i in content if not page.doubt[page.blocks[i][0]]]
    least = THRESHOLD * sum(plain) / len(plain) if plain else 0.0
    sums: dict[int, list[float]] = {}
    for i in usable:
        element, text, _ = page.blocks[i]
        total = sums.setdefault(page.doubt[element], [0.0, 0.0])
        total[0] += scores[i] * len(text)
        total[1] += len(text)
    stays = {e for e, (score, length) in sums.items() if not e or score >= least * length}
    return [i for i in usable if page.doubt[page.blocks[i][0]] in stays]


def _line(page: Page, at: int) -> list[int]:
    """The element and all above it."""
    line = [at]
    while page.parent[line[-1]] >= 0:
        line.append(page.parent[line[-1]])
    return line


def _with_rest(page: Page, usable: list[int], content: set[int], at: int, kept: list[int]) -> list[int]:
    """``kept`` and what of the article is beside the element ``at``, inside the same main element if there is one.

    These are blocks of content, punctuated paragraphs that stand directly in an element around ``at``, and
    headings that such blocks follow.
    """
    around, held = set(_line(page, at)[1:]), set(kept)
    follows = False
    for i in reversed(usable):
        element, text, linked = page.blocks[i]
        heading = page.tag[element] in HEADINGS
        if i not in held and (page.within[element] or not page.within[at]):
            beside = page.tag[element] == "p" and page.parent[element] in around
            prose = beside and linked * 2 < len(text) and PUNCTUATION.search(text) and not COPYRIGHT.match(text)
            if follows if heading else i in content or prose:
                held.add(i)
        follows = i in held or (heading and follows)
    return sorted(held)


def _below(page: Page, at: int) -> list[bool]:
    inside = [False] * len(page.tag)
    for element in range(len(page.tag)):
        inside[element] = element == at or (element > 0 and inside[page.parent[element]])
    return inside


def _with_headings(page: Page, usable: list[int], content: set[int], at: int) -> int:
    """Up from ``at`` as long as that adds headings and content only."""
    for _ in range(3):
        above = page.parent[at]
        if page.tag[at] == "article" or above <= 0 or page.tag[above] in ("body", "html"):
            break
        wide, own = _below(page, above), _below(page, at)
        added = [i for i in usable if wide[page.blocks[i][0]] and not own[page.blocks[i][0]]]
        if any(i not in content and page.tag[page.blocks[i][0]] not in HEADINGS for i in added):
            break
        at = above
    return at


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(key, url, text, n_chars) for every row.

    A null or empty page, and one without text outside menus and the like, has an empty text. Broken mark-up
    is read as browsers do where that is simple: open elements end with the page. Repeated rows give
    repeated results; an empty table no rows; other columns are not read.
    """
    rows = pages.select(key, url, source)
    kinds = f"`{key}` {rows.schema[key].dataType.simpleString()}, `{url}` {rows.schema[url].dataType.simpleString()}"

    def extract(batches):
        for whole in batches:
            for batch in slices(whole, source):
                texts = [main_text(page) for page in batch.column(source).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(key),
                        batch.column(url),
                        pa.array(texts, pa.string()),
                        pa.array([len(t) for t in texts], pa.int64()),
                    ],
                    names=[key, url, "text", "n_chars"],
                )

    return rows.mapInArrow(extract, f"{kinds}, text string, n_chars bigint")
