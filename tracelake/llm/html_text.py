"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element, each with the part of the page that it stands in: the outermost article or
main element, else the topmost container below body. Elements that hold no article text by tag or role leave nothing. Forms, and
containers marked by a word of class or id, keep their lines until the page is read: such an element then goes, unless it wraps an
article or main element, or, where no article stands outside such elements, holds more than half of the page's text without links, or
is prose inside an article whose mark is part of a longer name (`related-work`). Reader comments go whatever their size. A sliding window sums text lengths without links over the lines of the whole page, with empty lines between parts so
that no window holds lines of two; lines of article and main elements count `HINT` times, and `LINE_HINT` characters more. A stretch begins where the sums surge to
the threshold (`DENSE` characters, at most half of the largest sum) and ends where they dive below it, in whatever parts; a dive of
no more lines than the window is bridged. The stretch with the largest sum of counts is the main text. If it lies in article or main
elements by more than half, the main text is all text of those elements of that kind that any stretch touches and that are not mostly
links, and of an only one of the other kind, so their own borders sharpen surge and dive.

Defined results: null or empty html gives empty text and 0; unclosed elements end with their parents or the page; ties go to the
earlier stretch; repeated rows give equal results; other columns pass. A quote opens after an equals sign only; from the first tag
that never closes because of its quotes, quotes no longer hide `>`, and a tag without any `>` ends the page. Elements nested deeper than
`DEPTH` open no level of their own. So the time is linear in the page, however broken it is.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, widened

WINDOW = 3
DENSE = 80
#: How often a character in an article or main element counts, and how much each of its lines counts besides.
HINT, LINE_HINT = 5, 80
DEPTH = 512
# Fixed values of HTML: elements without content, blocks, and elements that hold no article text.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
_CLOSES_P = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "title", "summary"}
_DROPPED = set("aside audio button canvas datalist dialog footer head iframe map menu nav noscript object option select svg template textarea title video".split())
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style textarea title noscript template iframe xmp".split()}
_PEERS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = set("article aside body div dl footer header main nav ol section table ul".split())
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "alertdialog", "menu", "menubar", "toolbar"}
# Words of class or id that mark what is not the article.
_MARKS = set(
    "ad ads advert adverts advertisement advertising adbox adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus "
    "footer gdpr masthead menu modal nav navbar navigation navi newsletter notice notices notification overlay pager pagination popup promo promoted promotion related replies "
    "respond rss share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
_COMMENTS = {"comment", "comments", "commentlist", "disqus", "replies", "respond"}
#: Words that make a list one of comments.
_TALK = {"discussion", "discussions", "reactions"}
# Words that say nothing of what a marked element holds.
_PLAIN = set("area bar block body bottom box button buttons container content element form group head header icons inner item items left link links list module nav outer panel posts right row section stories text top wrap wrapper".split())
_OPEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_REST = re.compile(r"(?>=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+>")
# Names with their values in order, so that no value is read as a name.
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements that the words of class and id can mark; a heading, paragraph or inline element is text of what holds it.
_CONTAINERS = set("address center dd details div dl dt fieldset figure header li ol section table tbody td tfoot th thead tr ul".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


class _Mark:
    """An open or closed element that may be boilerplate: what it holds, and the marked element around it."""

    def __init__(self, around: int, comments: bool, named: bool, in_article: bool):
        self.around, self.comments, self.named, self.in_article = around, comments, named, in_article
        self.chars, self.linked, self.article = 0, 0, False


def _boilerplate(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool, bool] | bool:
    """True: leaves nothing. False: is text. Else what `_Mark` needs: whether it holds comments, and whether a mark is part of a longer name."""
    if tag in _DROPPED or (tag == "header" and not in_article):
        return True
    found: tuple | bool = (False, False) if tag == "form" else False
    top = tag in ("html", "body", "article", "main")
    for name, *values in _ATTR.findall(attrs) if attrs else ():
        value = next((v for v in values if v), "")
        name = name.lower()
        if name in ("class", "id"):
            for token in value.split():
                words = {w.lower() for w in _WORD.findall(token)}
                talk = bool(words & _COMMENTS) or tag in ("ol", "ul", "dl") and bool(words & _TALK)
                if top and tag != "body" and words & {"comment", "comments", "commentlist"}:
                    return True
                if tag in _CONTAINERS and (talk or words & _MARKS):
                    before = found or (False, True)
                    found = (before[0] or talk, before[1] and bool(words - _MARKS - _PLAIN))
        elif top:
            continue
        elif name == "role":
            if value.lower() in _ROLES:
                return True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
    return found


def _dropped(marks: list[_Mark], lines: list[tuple]) -> list[bool]:
    """Which marked elements are boilerplate; one inside such a one is too."""

    def clear(k: int) -> bool:
        while k >= 0 and marks[k].article and not marks[k].comments:
            k = marks[k].around
        return k < 0

    outside = {k: clear(k) for k in {x[4] for x in lines if x[2]}}
    whole = sum(len(text) - linked for text, _, _, linked, _ in lines)
    alone = not any(outside.values())
    gone: list[bool] = []
    for m in marks:
        prose = m.chars - m.linked
        stays = m.article and not m.comments
        stays = stays or alone and 2 * prose > whole and (m.article or not m.comments)
        stays = stays or m.in_article and m.named and not m.comments and prose >= DENSE and 2 * m.linked < m.chars
        gone.append(not stays or m.around >= 0 and gone[m.around])
    return gone


def tags_of(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of each piece of markup; the name is empty where nothing opens or closes."""
    at, strict = 0, True
    while m := _OPEN.search(page, at):
        name = ""
        attrs = (m.end(), m.end())
        if m[1]:
            end = page.find("-->", m.end())
            at = len(page) if end < 0 else end + 3
        else:
            rest = _REST.match(page, m.end()) if strict and m[3] else None
            if rest:
                at = rest.end()
            else:
                strict = strict and not m[3]
                end = page.find(">", m.end())
                at = len(page) if end < 0 else end + 1
            if m[3]:
                name, attrs = m[3].lower(), (m.end(), at - 1)
                if name in _RAW and not m[2]:
                    end = _RAW[name].search(page, at)
                    name, at = "", end.end() if end else len(page)
        yield m.start(), at, bool(m[2]), name, page[attrs[0] : attrs[1]] if name else ""


def lines_of(page: str) -> list[tuple[str, int, str, int]]:
    """(text, part, `article` or `main` if the part is one, characters in links) for each block with text."""
    out: list[tuple[str, int, str, int, int]] = []
    marks: list[_Mark] = []
    marked: list[tuple[int, int]] = []  # depth and number of the marked elements that are open
    stack: list[str] = []
    opened: Counter = Counter()  # elements on the stack by name
    deep: Counter = Counter()  # open elements beyond DEPTH by name
    held: list[str] = []
    skip = None  # depth of the outermost boilerplate element that is open
    part, part_depth, parts, article, linked = 0, None, 0, "", 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                inside = marked[-1][1] if marked else -1
                out.append((text, part, article, min(linked, len(text)), inside))
                if marked:
                    marks[inside].chars += len(text)
                    marks[inside].linked += min(linked, len(text))
        linked = 0

    def close(depth: int) -> None:
        nonlocal skip, part, part_depth, article, parts
        if any(t in _BLOCK for t in stack[depth:]):
            flush()
        opened.subtract(stack[depth:])
        del stack[depth:]
        while marked and marked[-1][0] >= depth:
            own = marks[marked.pop()[1]]
            if own.around >= 0:
                marks[own.around].chars += own.chars
                marks[own.around].linked += own.linked
        if skip is not None and depth <= skip:
            skip = None
        if part_depth is not None and depth <= part_depth:
            parts += 1
            part, part_depth, article = parts, None, ""

    at = 0
    for start, end, closing, tag, attrs in tags_of(page):
        if skip is None and start > at:
            held.append(page[at:start])
            if opened["a"]:
                linked += start - at
        at = end
        if not tag:
            continue
        if closing:
            if deep[tag]:
                deep[tag] -= 1
                if tag in _BLOCK and skip is None:
                    flush()
            elif opened[tag]:
                close(len(stack) - 1 - stack[::-1].index(tag))
            elif tag in ("p", "br") and skip is None:
                flush() if tag == "p" else held.append(" ")
            continue
        if tag in ("br", "wbr", "img"):
            if skip is None and tag == "br":
                held.append(" ")
            continue
        if tag in _BLOCK:
            if tag in _CLOSES_P and opened["p"]:
                depth = len(stack) - 1 - stack[::-1].index("p")
                if not _SCOPES.intersection(stack[depth + 1 :]):
                    close(depth)
            if tag in _PEERS:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth] in _PEERS[tag]:
                        close(depth)
                        break
                    if stack[depth] in ("ul", "ol", "dl", "table", "article", "body"):
                        break
            if skip is None:
                flush()
        if tag in _VOID or attrs.rstrip().endswith("/") and tag in ("svg", "path", "use"):
            continue
        if len(stack) >= DEPTH:
            deep[tag] += 1
            continue
        stack.append(tag)
        opened[tag] += 1
        if skip is None:
            what = _boilerplate(tag, attrs, bool(article))
            if what is True:
                skip = len(stack) - 1
                continue
            if what:
                marks.append(_Mark(marked[-1][1] if marked else -1, *what, bool(article)))
                marked.append((len(stack) - 1, len(marks) - 1))
            if tag in ("article", "main"):
                k = marked[-1][1] if marked else -1
                while k >= 0 and not marks[k].article:
                    marks[k].article = True
                    k = marks[k].around
            if tag in ("article", "main") and not article or part_depth is None and tag in ("div", "section", "table", "ul", "ol"):
                parts += 1
                part, part_depth, article = parts, len(stack) - 1, tag if tag in ("article", "main") else ""
    if skip is None and at < len(page):
        held.append(page[at:])
    flush()
    close(0)
    gone = _dropped(marks, out)
    return [x[:4] for x in out if x[4] < 0 or not gone[x[4]]]


def main_lines(lines: list[tuple[str, int, str, int]], window: int = WINDOW) -> list[int]:
    """Numbers of the lines of the main text."""
    counts = [(len(text) - linked) * HINT + LINE_HINT * (len(text) > linked) if article else len(text) - linked for text, _, article, linked in lines]
    if not any(counts):
        counts = [len(text) for text, *_ in lines]
    values: list[int] = []
    place: list[int] = []
    for i, n in enumerate(counts):
        if i and lines[i - 1][1] != lines[i][1]:
            values += [0] * (window - 1)
        place.append(len(values))
        values.append(n)
    sums = np.convolve(values, np.ones(window, int))
    high = np.concatenate([[0], np.cumsum(sums >= min(DENSE, sums.max() / 2))])
    # a line is live if one of the windows over it is
    at = np.flatnonzero((high[window:] > high[:-window])[place])
    stretches = np.split(at, np.flatnonzero(np.diff(at) > window + 1) + 1)
    size = np.concatenate([[0], np.cumsum(counts)])
    best = max(stretches, key=lambda x: (size[x[-1] + 1] - size[x[0]], -x[0]))
    kept = range(best[0], best[-1] + 1)
    weight: Counter = Counter()
    for i in kept:
        weight[lines[i][2] or ""] += counts[i]
    if weight["article"] + weight["main"] < weight[""]:
        return list(kept)
    kind = max(("article", "main"), key=weight.__getitem__)
    prose: Counter = Counter()
    for text, part, _, linked in lines:
        prose[part] += len(text) - 2 * linked
    own = {lines[i][1] for i in at.tolist() if lines[i][2] == kind and (i in kept or prose[lines[i][1]] > 0)}
    # One element of the other kind beside them is part of the text; several are teasers of other pages.
    other = {part for _, part, what, _ in lines if what and what != kind}
    own |= other if len(other) == 1 and prose[min(other)] > 0 else set()
    return [i for i, (_, part, *_) in enumerate(lines) if part in own]


def main_text(page: str | None, window: int = WINDOW) -> str:
    lines = lines_of(page or "")
    return "\n\n".join(lines[i][0] for i in main_lines(lines, window)) if lines else ""


def extract(pages: DataFrame, window: int = WINDOW) -> DataFrame:
    """`pages` with text and n_chars; its own columns of those names give way."""
    pages = pages.drop("text", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, window) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*batch.schema.names, "text", "n_chars"])

    return pages.mapInArrow(run, widened(pages.schema, "text string, n_chars long"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
