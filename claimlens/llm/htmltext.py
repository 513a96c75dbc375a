"""Main text of web pages by the distribution of text over lines.

Markup is stripped to lines, one per block element. Every line has a weight: its visible
text length, ``MARK`` times that inside an article or main element, 0 in page furniture and
in lists of links. Weights are summed over a sliding window of ``WINDOW`` lines, which does
not reach over the edge of an article. In an article a region surges where the window sum
rises from nothing and dives where it falls back; elsewhere it must pass a quarter of the
page's usual line (the median, every line counted by its length), and short lines at the
edges that are neither headings nor sentences (menus, "Terms of use") are cut off. Regions whose
peak reaches an eighth of the page's highest are kept with all their lines that are no
furniture, also lines that are mostly a link, and link lists between their lines or
anywhere in a kept article. Between two kept regions without an article, lines with no
furniture among them stay.

Furniture: nav, header, footer, aside, menus, dialogs, buttons; elements hidden or with a
role of that kind; and, as a guess, forms and elements whose class or id names such a part
(words like ``has-sidebar`` or ``comments-open`` name a state, not a part). A guess gives way
where the element holds most of the article text, or most of the page's text and no
article is marked; one that names comments never does.

Defined cases: null or empty html gives the empty text. Broken markup is read as
browsers do in the simple cases: ``<p>`` and ``<li>`` end implicitly, an end tag without
a start is ignored, an open element lasts to the end of its parent, a tag without any
``>`` after it is text, an unfinished script or comment runs to the end, and once a quoted value
is never closed, tags end at their first ``>``. A page is read in one pass, in time linear in
its length.
"""

from __future__ import annotations

import html as _html
import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, MARK = 3, 2

_RAW = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>", re.I) for n in
        "script style noscript template textarea svg iframe object title".split()}
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_SPACE = re.compile(r"[\s/]*")
_KEY = re.compile(r"[^\s/>=][^\s/>=]*")
_VALUE = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
                    "samp small span strike strong sub sup time tt u var br img wbr".split())
_FURNITURE = frozenset("nav footer aside menu dialog button select option fieldset head header figure_ad".split())
_HINT = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|side-?bar|nav|navbar|navigation|menu|menubar|"
    r"breadcrumbs?|header|masthead|footer|comments?|commentlist|disqus|replies|respond|cookies?|consent|notice|"
    r"popup|modal|newsletter|subscribe|subscription|share|sharing|social|related|recommended|widget|login|"
    r"search|pagination|pager|toolbar|skip-link|gdpr|alert)(?:$|[_-])", re.I)
_STATE = re.compile(r"^(?:has|have|no|not|with|without|is|show|hide)[_-]|[_-](?:open|opened|closed|enabled|disabled|on|off|allowed)$", re.I)
_FIRM = re.compile(r"comment|disqus|replies|respond", re.I)
_ROLE = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_BREAKS_P = frozenset("p div ul ol dl table section article aside header footer nav form h1 h2 h3 h4 h5 h6 pre "
                      "blockquote figure main hr address fieldset".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_SENTENCE = re.compile(r"""[.!?:…]["'”’»)\]]*$""")
_RIGHTS = re.compile(r"^\s*(?:©|\(c\)|copyright\b)", re.I)


def _attributes(page: str, pos: int) -> tuple[dict[str, str] | None, int]:
    """The attributes from ``pos`` to the end of a tag and the place after its ``>``; None
    if a quoted value is never closed."""
    out: dict[str, str] = {}
    size = len(page)
    while True:
        pos = _SPACE.match(page, pos).end()
        if pos >= size:
            return None, size
        if page[pos] == ">":
            return out, pos + 1
        m = _KEY.match(page, pos)
        key, pos = (m[0].lower(), m.end()) if m else ("", pos)
        m = _VALUE.match(page, pos)
        value = ""
        if m:
            pos = m.end()
            quote = page[pos:pos + 1]
            if quote in ("'", '"') and quote:
                end = page.find(quote, pos + 1)
                if end < 0:
                    return None, size
                value, pos = page[pos + 1:end], end + 1
            else:
                m = _BARE.match(page, pos)
                value, pos = m[0], m.end()
        out.setdefault(key, value)


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, value, attributes) in order: "text", "open" or "close" with the lower-case name."""
    pos = text = 0
    last, quotes = page.rfind(">"), True
    while True:
        lt = page.find("<", pos)
        if lt < 0:
            break
        if lt > last:                                   # no tag ends any more: text up to a comment
            end = page.find("<!--", lt)
            if text < (end if end >= 0 else len(page)):
                yield "text", page[text:end] if end >= 0 else page[text:], {}
            return
        pos = lt + 1
        if page.startswith("!--", pos):
            end = page.find("-->", pos + 3)
            end = len(page) if end < 0 else end + 3
            kind = None
        elif page[pos:pos + 1] in ("!", "?"):
            end, kind = page.find(">", pos) + 1, None
        else:
            close = page.startswith("/", pos)
            m = _NAME.match(page, pos + close)
            if not m:
                continue                                # a lone "<" is text
            kind, name = "close" if close else "open", m[0].lower()
            attrs, end = _attributes(page, m.end()) if quotes else (None, 0)
            if attrs is None:
                quotes = False
                attrs, end = {}, page.find(">", m.end()) + 1
        if lt > text:
            yield "text", page[text:lt], {}
        if kind:
            yield kind, name, attrs
            if kind == "open" and name in _RAW:
                m = _RAW[name].search(page, end)
                end = m.end() if m else len(page)
                yield "close", name, {}
        pos = text = end
    if text < len(page):
        yield "text", page[text:], {}


def _part(name: str, attrs: dict[str, str], in_article: bool) -> str:
    """"hard" for furniture, "soft" or "firm" for a guess by class or id, else ""."""
    if name in _FURNITURE and not (name == "header" and in_article):
        return "hard"
    if not attrs:
        return "soft" if name == "form" else ""
    if ("hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or attrs.get("role", "").lower() in _ROLE
            or "display:none" in attrs.get("style", "").replace(" ", "").lower()):
        return "hard"
    if name in ("html", "body", "main", "header"):
        return ""
    words = [w for w in f"{attrs.get('class', '')} {attrs.get('id', '')}".split() if _HINT.search(w) and not _STATE.search(w)]
    if any(_FIRM.search(w) for w in words):
        return "firm"
    return "soft" if (words and name != "article") or name == "form" else ""


class Line:
    """A block's text: whether it is furniture, the number of its article or 0, 1 for a link
    or 2 for one in a list, whether it is a heading, and the innermost guessed part."""

    def __init__(self, text: str, odd: bool, inside: int, link: int, heading: bool, part: int):
        self.text, self.odd, self.inside, self.link, self.heading, self.part = text, odd, inside, link, heading, part


def lines(page: str) -> list[Line]:
    """The block lines of a page, in order."""
    out: list[Line] = []
    stack: list = []                        # (name, furniture, article, guessed part)
    parts: list[tuple[str, int]] = []       # guessed parts: (kind, the part around it)
    articles = 0
    pieces: list[str] = []                  # of the current line
    linked = n_links = n_items = n_heads = 0
    counted = {"a", "li", *_HEADING}
    blocks: dict[str, int] = {}             # open block elements by name
    runs: list[dict[str, int]] = [{}]       # open inline elements by name, after each open block

    def state():
        return stack[-1][1:] if stack else (False, 0, -1)

    def push(name, *rest):
        nonlocal n_links, n_items, n_heads
        stack.append((name, *rest))
        if name in _INLINE:
            runs[-1][name] = runs[-1].get(name, 0) + 1
        else:
            blocks[name] = blocks.get(name, 0) + 1
            runs.append({})
        if name in counted:
            n_links, n_items, n_heads = n_links + (name == "a"), n_items + (name == "li"), n_heads + (name in _HEADING)

    def pop():
        nonlocal n_links, n_items, n_heads
        name = stack.pop()[0]
        if name in _INLINE:
            runs[-1][name] -= 1
        else:
            blocks[name] -= 1
            runs.pop()
        if name in counted:
            n_links, n_items, n_heads = n_links - (name == "a"), n_items - (name == "li"), n_heads - (name in _HEADING)

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join(_html.unescape("".join(pieces)).split())
            if text:
                odd, inside, part = state()
                links = linked > 0.8 * len(text) and (n_items > 0 or not inside)
                out.append(Line(text, odd, inside, links * (1 + (n_items > 0)), n_heads > 0, part))
            pieces.clear()
        linked = 0

    def guessed(kind, part):
        if kind in ("soft", "firm"):
            parts.append((kind, part))
            return len(parts) - 1
        return part

    for kind, name, attrs in tokens(page):
        if kind == "text":
            pieces.append(name)
            if n_links:
                linked += len(name.strip())
        elif kind == "close":
            if name in _INLINE:
                if runs[-1].get(name):
                    while stack[-1][0] != name:
                        pop()
                    pop()
            else:
                flush()
                if blocks.get(name):
                    while stack[-1][0] != name:
                        pop()
                    pop()
        elif name == "br":
            pieces.append(" ")
        elif name in _VOID:
            if name == "hr":
                flush()
        elif name in _INLINE:
            odd, inside, part = state()
            found = _part(name, attrs, inside > 0) if attrs and name != "a" else ""
            if found and not odd:
                flush()
            push(name, odd or found == "hard", inside, guessed(found, part))
        else:
            flush()
            while stack and stack[-1][0] in _INLINE:      # inline elements left open end with their block
                pop()
            # <li> ends an open <li>, also over an open <p>; other blocks end an open <p>
            over = len(stack) > 1 and name == "li" and stack[-1][0] == "p" and stack[-2][0] == "li"
            if over or stack and stack[-1][0] == ("li" if name == "li" else "p" if name in _BREAKS_P else None):
                pop()
                if over:
                    pop()
            odd, inside, part = state()
            found = _part(name, attrs, inside > 0)
            if (name in ("article", "main") or attrs.get("role", "").lower() == "main") and found != "firm":
                articles += 1
                inside = articles
            push(name, odd or found == "hard", inside, guessed(found, part))
    flush()
    _settle(out, parts)
    return out


def _settle(found: list[Line], parts: list[tuple[str, int]]) -> None:
    """Mark the lines of guessed parts as furniture, except of those that hold the text."""
    if not parts:
        return
    firm: list[bool] = []
    for kind, around in parts:
        firm.append(kind == "firm" or around >= 0 and firm[around])
    for line in found:
        line.odd = line.odd or line.part >= 0 and firm[line.part]
    size, marked = [0] * len(parts), [0] * len(parts)
    for line in found:
        if not line.odd and line.part >= 0:
            size[line.part] += len(line.text)
            marked[line.part] += len(line.text) * (line.inside > 0)
    whole = sum(len(x.text) for x in found if not x.odd)
    articles = sum(len(x.text) for x in found if not x.odd and x.inside)
    for i in range(len(parts) - 1, -1, -1):            # a part comes after the one around it
        if parts[i][1] >= 0:
            size[parts[i][1]] += size[i]
            marked[parts[i][1]] += marked[i]
    drop: list[bool] = []
    for i, (_, around) in enumerate(parts):
        holds = 2 * marked[i] > articles and 3 * marked[i] >= whole if articles else 3 * size[i] > 2 * whole
        drop.append(firm[i] or around >= 0 and drop[around] or not holds)
    for line in found:
        line.odd = line.odd or line.part >= 0 and drop[line.part]


def main_text(page: str | None) -> str:
    """The text between the surge and dive points of the page's line weights."""
    if not page:
        return ""
    found = lines(page)
    weight = [0 if x.odd or x.link else len(x.text) * (MARK if x.inside else 1) for x in found]
    usual = _usual([w for w, x in zip(weight, found) if not x.inside])
    regions: list = []          # [peak, article, (surge, dive) of each part]
    of_article: dict = {}
    start = 0
    for inside, group in itertools.groupby(found, key=lambda x: x.inside):
        end = start + len(list(group))
        for peak, surge, dive in _parts(weight, start, end, 0 if inside else usual / 4):
            if not inside:
                surge, dive = _trimmed(found, weight, surge, dive, usual)
            region = of_article.get(inside) if inside else None
            if region is None:
                regions.append(region := [0, inside, []])
                of_article[inside] = region
            region[0] = max(region[0], peak)
            region[2].append((surge, dive))
        start = end
    low = max((r[0] for r in regions), default=0) / 8
    chosen = [r for r in regions if r[0] >= low]
    kept = {k for r in chosen for lo, hi in r[2] for k in range(lo, hi) if weight[k] or found[k].link == 1}
    for a, b in itertools.pairwise(r for r in chosen if not r[1]):
        gap = range(a[2][-1][1], b[2][0][0])
        if all(not found[k].odd and not found[k].inside for k in gap):
            kept.update(k for k in gap if weight[k])
    whole = {r[1] for r in chosen if r[1]}
    before = None               # the last kept line that has weight, with no furniture or other article since
    for k, x in enumerate(found):
        if x.inside in whole and x.link and not x.odd:
            kept.add(k)
        if weight[k] and k in kept:
            if before is not None and found[before].inside == x.inside:
                kept.update(i for i in range(before + 1, k) if found[i].link)
            before = k
        elif x.odd or not x.link or before is not None and found[before].inside != x.inside:
            before = None
    return "\n\n".join(found[k].text for k in sorted(kept) if not found[k].odd)


def _usual(weights: list[int]) -> float:
    """The weight at which half of all weight lies in lighter lines."""
    half, total = sum(weights) / 2, 0
    for w in sorted(weights):
        total += w
        if total >= half:
            return w
    return 0


def _trimmed(found: list[Line], weight: list[int], surge: int, dive: int, usual: float) -> tuple[int, int]:
    """The region without lines at its edges that are under half of the usual line and neither
    headings nor sentences, or state rights."""
    def loose(k: int) -> bool:
        x = found[k]
        if x.link or x.heading:
            return False
        return weight[k] < usual / 2 and not _SENTENCE.search(x.text) or weight[k] < usual and bool(_RIGHTS.match(x.text))

    while surge < dive and loose(surge):
        surge += 1
    while surge < dive and loose(dive - 1):
        dive -= 1
    return surge, dive


def _parts(weight: list[int], start: int, end: int, low: float) -> Iterator[tuple[int, int, int]]:
    """(peak, surge, dive) of each run of lines whose window sum is over ``low``."""
    total = [0]
    for w in weight[start:end]:
        total.append(total[-1] + w)
    n, half = end - start, WINDOW // 2
    window = [total[min(n, i + half + 1)] - total[max(0, i - half)] for i in range(n)]
    i = 0
    while i < n:
        if window[i] <= low:
            i += 1
            continue
        dive = i                                       # surge at i: find the dive
        while dive < n and window[dive] > low:
            dive += 1
        yield max(window[i:dive]), start + i, start + dive
        i = dive


def extract(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole page."""
    @F.pandas_udf("string")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield s.map(main_text)

    return pages.withColumn(name, run(F.coalesce(F.col(html), F.lit(""))))
