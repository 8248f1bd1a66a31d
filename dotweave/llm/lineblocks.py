"""Main-text extraction from HTML by line-block distribution.

Mark-up is stripped into lines (one per block-level element). A removed menu,
footer, advert or the like leaves a gap of empty lines. Text lengths are summed
over sliding windows of lines; a window that rises to the threshold is a surge
point, an all-empty window is a dive point, and the lines between are kept.

Mark-up only weighs lines. Where a page marks its article (``article`` or ``main``),
a line inside counts ``INSIDE`` times its length and at least a surge of its own, and
one outside nothing, so surge and dive points fall on its bounds and its shortest
paragraphs survive; articles that hold less than a third of the text are teasers and
mark nothing. On pages without one, lines that are mostly links count nothing. A block
that was found goes on over the whole of its container: what stands in the same
``div``, section or table cell and wasn't removed is kept too; so are short
lines between kept blocks, a heading directly before one, and sentences directly
behind one.

A class or id speaks for boilerplate only if the element holds no article, except that
comments hold articles of readers; if the word is but a part of its name, only if the
element holds at most half of the text; and words that an article may use of itself
(``FAINT``) only if the element is mostly links.

A page is read in one pass over its tags: where elements end, how much text and how
many articles they hold, follow from stacks and running sums, so the time is in
proportion to the page, however its tags are nested, left open or cut off.

Edge cases: a null or empty page gives ''; a page cut off mid-tag is read to
its end; a page is read whole, however long; other columns
than those kept are not read; a page whose windows all stay under the threshold keeps the run of
lines around its largest window; repeated pages give repeated rows.
"""

from __future__ import annotations

import html as _html
import re

from pyspark.sql import DataFrame

from dotweave.llm.common import map_text

WINDOW = 3
SURGE = 80
#: How many times a character inside a marked article counts.
INSIDE = 4

# Element names of HTML by role.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style textarea title noscript template svg math iframe object canvas audio video select noframes".split())
SKIPPED = frozenset("nav footer aside form button dialog menu head label input".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
# Words in class or id that mark boilerplate wherever they stand, and those that do so outside the article only.
NOISE = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login related recommended share sharing social comment comments commentlist replies reply reviews feedback disqus respond widget pagination pager toolbar masthead skip".split())
OUTER_NOISE = frozenset("header head top topbar alert search meta".split())

# Of NOISE, words for readers' comments, and words that an article may use of itself.
COMMENTS = frozenset("comment comments commentlist replies reply respond disqus".split())
FAINT = frozenset("share sharing social related recommended notice notices reviews widget menu skip feedback promotion".split())
#: Elements whose lines belong together.
CONTAINERS = frozenset("div section td article main".split())

#: A comment, a declaration, or a tag; a quote counts behind an equals sign if it is ever closed. What is read is never read again.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</?([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z0-9]+")
# Beginnings of names that say what the page has or is about, not what the element is.
ABOUT = re.compile(r"(?:no|has|with|without|tag|category|is)[-_]")
SENTENCE = re.compile(r"[.!?\u2026][\"'\u201d\u2019)]*$")
HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


def _noisy(name: str, attributes: str, inside: bool) -> tuple[str, bool, bool]:
    """Why an element is boilerplate: "" (it is not), "sure", or "name" or "part" if only its class or id says so, by a whole name or a part of one; whether it speaks of comments, and whether in faint words only."""
    if name in SKIPPED or (name == "header" and not inside):
        return "sure", False, False
    if not attributes or name in ("html", "body", "main") or name[0] == "h" and name[1:].isdigit():
        return "", False, False
    if HIDDEN.search(attributes):
        return "sure", False, False
    said, words = "", set()
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        if key.lower() == "role":
            if value.strip() in ROLES:
                return "sure", False, False
        else:
            noise = NOISE if inside or name == "article" else NOISE | OUTER_NOISE
            for one in value.split():
                if one in noise:
                    said = "name"
                    words.add(one)
                elif not ABOUT.match(one):
                    found = noise & set(WORD.findall(one))
                    said = said or (found and "part")
                    words |= found
    return said or "", bool(words & COMMENTS), words <= FAINT


class _Page:
    """A page's texts and tags in order, where each element ends, and running sums of text and articles."""

    def __init__(self, html: str):
        self.kind: list[str] = []  # "text", "open" or "close"
        self.name: list[str] = []  # a tag's name, or a text
        self.attributes: list[str] = []
        self.end: list[int] = []  # of an opening tag, the number of the first item behind its element
        self.plain, self.all, self.marked = [0], [0], [0]
        opened: dict[str, list[int]] = {}
        closers: dict[str, re.Pattern] = {}
        anchors = at = 0
        n = len(html)

        def item(kind: str, name: str, attributes: str = "") -> None:
            size = len("".join(name.split())) if kind == "text" else 0
            self.kind.append(kind)
            self.name.append(name)
            self.attributes.append(attributes)
            self.end.append(-1)
            self.all.append(self.all[-1] + size)
            self.plain.append(self.plain[-1] + (0 if anchors else size))
            self.marked.append(self.marked[-1] + (kind == "open" and name in ("article", "main")))

        def ended(name: str) -> None:
            for k in opened.pop(name, ()):
                self.end[k] = len(self.kind)

        while at < n:
            m = TOKEN.search(html, at)
            begin = n if m is None else m.start()
            if begin > at:
                item("text", _html.unescape(html[at:begin]))
            if m is None:
                break
            at = m.end()
            tag = (m[1] or "").lower()
            if not tag:
                continue
            if html[begin + 1] == "/":
                if tag in ("ul", "ol"):
                    ended("li")
                if tag == "a":
                    anchors = max(0, anchors - 1)
                item("close", tag)
                if opened.get(tag):
                    self.end[opened[tag].pop()] = len(self.kind)
                continue
            if tag in RAW:
                # Its content is no mark-up; without its end the page is over.
                close = closers.setdefault(tag, re.compile(rf"</{tag}\b[^>]*+(?:>|\Z)", re.I)).search(html, at)
                at = n if close is None else close.end()
                continue
            if tag in BLOCKS:
                ended("p")
            if tag == "li":
                ended("li")
            item("open", tag, m[2])
            if tag not in VOID and not m[2].endswith("/"):
                opened.setdefault(tag, []).append(len(self.kind) - 1)
            if tag == "a":
                anchors += 1
        for name in list(opened):
            ended(name)


def lines_of(html: str) -> list[tuple[str, int, bool, bool, int]]:
    """(text, characters outside links, inside the article, a heading, container) of each line; gaps are empty lines."""
    page = _Page(html)
    out: list[tuple[str, int, bool, bool, int]] = []
    parts: list[str] = []
    plain = 0
    heading = False
    inside = anchors = 0
    around = 0, len(page.kind)  # the article that is open, or the page
    within: list[tuple[int, int]] = []  # containers that are open, and where they end

    def flush() -> None:
        nonlocal plain, heading
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, plain, inside > 0, heading, within[-1][0] if within else -1))
            parts.clear()
            plain = 0
        heading = False

    def gap() -> None:
        flush()
        if not inside:
            out.extend([("", 0, False, False, -1)] * WINDOW)

    def noise(i: int, tag: str) -> bool:
        said, comments, faint = _noisy(tag, page.attributes[i], inside > 0)
        if said in ("", "sure"):
            return said == "sure"
        hi = page.end[i]
        text, articles = page.plain[hi] - page.plain[i], page.marked[hi] - page.marked[i + 1]
        if articles and not (comments and articles < page.marked[-1] - (tag in ("article", "main"))):
            return False
        if faint and 2 * text > page.all[hi] - page.all[i]:
            return False
        return said == "name" or 2 * text <= page.plain[around[1]] - page.plain[around[0]]

    i, n = 0, len(page.kind)
    while i < n:
        kind, tag = page.kind[i], page.name[i]
        while within and within[-1][1] <= i:
            flush()
            within.pop()
        if kind == "text":
            parts.append(tag)
            if not anchors:
                plain += len("".join(tag.split()))
        elif kind == "close":
            if tag in ("article", "main"):
                flush()
                inside = max(0, inside - 1)
                if not inside:
                    around = 0, n
                    gap()
            elif tag == "a":
                anchors = max(0, anchors - 1)
            elif tag in BLOCKS:
                flush()
        elif tag not in VOID and noise(i, tag):
            gap()
            i = max(page.end[i], i + 1)
            continue
        else:
            if tag in ("article", "main"):
                gap()
                if not inside:
                    around = i, max(page.end[i], i + 1)
                inside += 1
            elif tag == "a":
                anchors += 1
            elif tag == "br":
                parts.append(" ")
            elif tag in BLOCKS:
                flush()
                heading = tag in HEADINGS
            if tag in CONTAINERS:
                within.append((i, page.end[i]))
        i += 1
    flush()
    return out


def main_text(html: str, window: int = WINDOW, surge: int = SURGE) -> str:
    lines = lines_of(html)
    within = sum(line[1] for line in lines if line[2])
    marked = any(line[2] for line in lines) and 2 * within >= sum(line[1] for line in lines if not line[2])
    if marked:
        size = [max(surge, INSIDE * len(t)) if inside and t else 0 for t, _, inside, _, _ in lines]
    else:
        size = [len(t) * (2 * plain >= len(t) or plain >= surge) for t, plain, _, _, _ in lines]
    sums = [sum(size[i : i + window]) for i in range(len(size))]
    n = len(size)
    chosen = [False] * n
    i = 0
    while i < n:
        if size[i] == 0 or sums[i] < surge:
            i += 1
            continue
        while i < n and sums[i] > 0:
            chosen[i] = size[i] > 0
            i += 1
    if not marked and any(chosen):
        # It doesn't begin with a few words of another container that are neither a heading nor a sentence.
        weight: dict[int, int] = {}
        for i, c in enumerate(chosen):
            weight[lines[i][4]] = weight.get(lines[i][4], 0) + c * size[i]
        begin = next((i for i in range(n) if chosen[i] and (lines[i][4] == -1 or weight[lines[i][4]] >= surge or lines[i][3] or SENTENCE.search(lines[i][0]))), 0)
        chosen[:begin] = [False] * begin
        # A block goes on over its container, unless that is the page itself.
        found = {line[4] for line, c in zip(lines, chosen) if c} - {-1}
        chosen = [c or size[i] > 0 and lines[i][4] in found for i, c in enumerate(chosen)]
        first, last = chosen.index(True), n - 1 - chosen[::-1].index(True)
        # Directly before: back to the heading, if one of the lines of a window is it.
        above = first
        while above > max(0, first - window) and size[above - 1]:
            above -= 1
        first = next((i for i in range(above, first) if lines[i][3]), first)
        for i in range(first, last):
            chosen[i] = size[i] > 0
        # Directly behind: the next run of lines, as far as they are sentences.
        i = last + 1
        while i < n and not size[i]:
            i += 1
        while i < n and size[i] and SENTENCE.search(lines[i][0]):
            chosen[i] = True
            i += 1
    kept = [lines[i][0] for i in range(n) if chosen[i]]
    if not kept and any(size):
        best = max(range(n), key=lambda j: (sums[j], -j))
        while best > 0 and any(size[max(0, best - window) : best]):
            best -= 1
        while best < n and sums[best] > 0:
            if size[best]:
                kept.append(lines[best][0])
            best += 1
    return "\n".join(kept)


def extract(df: DataFrame, keep: list[str], html: str = "html", window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """``keep`` plus ``text`` (the main text) and ``n_chars`` (its code points), one row a page, without a shuffle."""

    def rows(pages: list[str]):
        for page in pages:
            text = main_text(page, window, surge)
            yield text, len(text)

    return map_text(df, keep, html, "text string, n_chars bigint", rows)
