"""Main text of HTML pages by line-block distribution.

Markup is stripped first: each block element's text becomes a line; comments, scripts and styles vanish;
lines of menus, headers, footers, sidebars, notices, adverts and reader comments weigh nothing; link text
does not count. Over the lines' weights a window of ``WINDOW`` lines is summed. A run of lines starts at
the surge, where the window ahead reaches the threshold, and ends at the dive, where the window behind
falls under it; all lines between stay. A dive made by short lines and not by links is none: it is filled. The threshold is at most half of the page's fullest
window, so that a short page still has its text.

A declared article only adds weight to its lines: lines outside are decided by the same windows, and a
list of links inside has a dive. Windows do not reach over an article's edge. An article marked as a
comment is one, and so is an article inside of such a container.

A container that is dropped by its kind or marks is taken back where it must be the page itself: a form
with more text than all outside of it, a container round <main>, one with the page's only article, one
that never closes from its first article on, and any but comments if nothing else has text.

Row-local: one Arrow UDF, no shuffle. Defined cases: null or empty html gives an empty text; unclosed
elements end with their container or where HTML implies it; a line break is white space; unknown references stay as written; broken markup
costs no more time than its length, and any length is read whole; a column of the name ``to`` is replaced, all others pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 3
THRESHOLD = 80

# Element names and words of class, id and role by their use in HTML.
HIDDEN = set("script style noscript template svg iframe select button canvas head title".split())
DROPPED = HIDDEN | set("nav header footer aside form object dialog".split())
ARTICLE = {"article", "main"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol optgroup option p pre section summary table tbody td tfoot"
    " th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NOISE = set(
    "ad ads advert adverts advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar notice"
    " notices cookie cookies consent gdpr popup modal comment comments disqus replies social share sharing related newsletter subscribe login search pager"
    " pagination contentinfo complementary".split()
)
COMMENT = {"comment", "comments", "disqus", "replies"}
LESSER = {"comment", "comments", "reply", "replies", "teaser", "related", "promo", "ad", "advert", "sponsored"}  # of an outer article
# Parts that may stand beside a noise word in a compound; any other part ("article-header", "social-science") names a thing of its own.
BESIDE = set(
    "site page main global top bottom left right primary secondary inner outer list item items box bar slot unit links link buttons button icons wrapper wrap"
    " container content section area block widget panel group row col column inline sticky overlay mobile desktop form field thread bottom head foot".split()
)
RAW = {"script", "style", "textarea"}
NAME = re.compile(r"<(/?)([a-z][a-z0-9:-]*)", re.I)
CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
UNTIL = re.compile(r"[^>\"']*")
MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
IN_HEAD = set("base link meta noscript script style template title".split())
# A start tag ends these open elements, up to the nearest of those.
CELLS = {"td", "th"}
ROWS = CELLS | {"tr", "caption"}
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "td": (CELLS, {"tr", "table"}), "th": (CELLS, {"tr", "table"}), "tr": (ROWS, {"table"}),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (ROWS | {"thead", "tbody", "tfoot"}, {"table"})),
}
EDGES = {"table", "td", "th", "caption"}
TABLE = EDGES | {"tr", "thead", "tbody", "tfoot"}
PLAIN, FORM, NOISY, COMMENTS, NEVER = range(5)


class _Open:
    """An open element; kind: what its lines are. inner: the line of its first article; main: that is a <main>.
    until: the line from which on its lines are plain."""

    __slots__ = ("name", "kind", "article", "inner", "main", "until")

    def __init__(self, name: str, kind: int, article: bool):
        self.name, self.kind, self.article, self.inner, self.main, self.until = name, kind, article, None, False, None


class _Token:
    """A piece of markup; one without a name (comments, raw text, declarations) is only taken out."""

    __slots__ = ("start", "stop", "name", "end", "attrs")

    def __init__(self, start: int, stop: int, name: str = "", end: bool = False, attrs: str = ""):
        self.start, self.stop, self.name, self.end, self.attrs = start, stop, name, end, attrs


def tokens(html: str) -> Iterator[_Token]:
    """Markup in page order, in linear time: what is once found to be missing behind a place is not searched again.

    Comments and raw text that never close reach to the end. A "<" without ">" behind it is text. Where a quoted value never closes, this tag and
    those behind it end at their first ">".
    """
    at, size = html.find("<"), len(html)
    quoted = True  # whether ">" in quotes is no end of a tag
    last = html.rfind(">")
    open_ended: set[str] = set()  # raw elements that have no closing tag any more
    while 0 <= at:
        stop = at + 1
        if html.startswith("<!--", at):
            found = html.find("-->", at + 4)
            stop = size if found < 0 else found + 3
            yield _Token(at, stop)
        elif at > last:
            pass
        elif html.startswith(("<!", "<?"), at):
            stop = html.find(">", at) + 1
            yield _Token(at, stop)
        elif m := NAME.match(html, at):
            name, close = m[2].lower(), bool(m[1])
            if name in RAW and not close:
                stop = html.find(">", at) + 1
                found = None if name in open_ended else CLOSING[name].search(html, stop)
                if not found:
                    open_ended.add(name)
                stop = found.end() if found else size
                yield _Token(at, stop)
            else:
                i = m.end()
                while quoted:
                    i = UNTIL.match(html, i).end()
                    if i >= size:
                        quoted = False
                    elif html[i] == ">":
                        break
                    else:
                        i = html.find(html[i], i + 1) + 1
                        quoted = i > 0
                if not quoted:
                    i = html.find(">", m.end())
                if i >= 0:
                    stop = i + 1
                    yield _Token(at, stop, name, close, html[m.end() : i])
        at = html.find("<", stop)


def _noisy(words: list[str], inside: set[str]) -> bool:
    """Whether one of the class words is noise: a noise word, alone or in a compound with words that may stand beside it."""
    for word in words:
        parts = re.split(r"[-_]+", word)
        if not inside.isdisjoint(parts) and (not COMMENT.isdisjoint(parts) or all(p in inside or p in BESIDE for p in parts)):
            return True
    return False


def _kind(name: str, attrs: str, article: bool, inner: bool) -> int:
    """article: inside one; inner: inside an article or a dropped element."""
    if name in HIDDEN:
        return NEVER
    if name in ("html", "body", "main"):
        return PLAIN
    marks = " ".join(MARKS.findall(attrs)).lower().replace('"', " ").replace("'", " ").split()
    if _noisy(marks, LESSER if name == "article" and not inner else NOISE):
        return COMMENTS if any(not COMMENT.isdisjoint(re.split(r"[-_]+", x)) for x in marks) else NOISY
    if name == "header" and article:
        return PLAIN  # the article's own, with its heading
    return FORM if name == "form" else NOISY if name in DROPPED else PLAIN


def page_lines(html: str) -> list[tuple[str, int, bool, int]]:
    """(text, weight, in an article, kind) of each block, in page order."""
    found: list[tuple[str, int, bool, tuple[_Open, ...]]] = []
    parts: list[str] = []
    stack: list[_Open] = []
    many: Counter[str] = Counter()  # open elements by name
    noisy: list[_Open] = []  # open elements whose lines are not plain
    linked = at = articles = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                found.append((text, max(0, len(text) - linked), articles > 0, tuple(noisy)))
            parts.clear()
        linked = 0

    def pop(closed: bool = True) -> None:
        nonlocal articles
        x = stack.pop()
        many[x.name] -= 1
        if x.kind:
            flush()
            noisy.pop()
            if x.main or not closed:
                x.until = x.inner
        articles -= x.article

    def pop_to(i: int, closed: bool = True) -> None:
        """Ends the element at ``i`` by its tag, those inside it without theirs."""
        while len(stack) > i + 1:
            pop(stack[-1].name in IMPLIED or stack[-1].name in ("p", "a"))
        pop(closed)

    for token in tokens(html):
        if token.start > at:
            parts.append(html[at : token.start])
            if many["a"]:
                linked += token.start - at
        at, name = token.stop, token.name
        if not name:
            continue
        if name == "br":
            parts.append(" ")
        block = name in BLOCKS
        if block:
            flush()
        if token.end:
            if many[name]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name == name:
                        pop_to(i)
                        break
                    if stack[i].name in EDGES and name not in TABLE or not block and stack[i].name in BLOCKS:
                        break
            continue
        while many["title"] or many["head"] and name not in IN_HEAD:
            pop()
        if block and many["p"]:
            i = len(stack) - 1
            while i >= 0 and stack[i].name not in BLOCKS:
                i -= 1
            if i >= 0 and stack[i].name == "p":
                pop_to(i)
        if name in IMPLIED:
            ends, until = IMPLIED[name]
            last = None
            if any(many[x] for x in ends):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name in until or stack[i].name in EDGES and name not in TABLE:
                        break
                    if stack[i].name in ends:
                        last = i
            if last is not None:
                pop_to(last)
        elif name == "a" and many["a"] and stack[-1].name == "a":
            pop()
        if name in VOID:
            continue
        kind = _kind(name, token.attrs, articles > 0, articles > 0 or bool(noisy))
        if kind and token.attrs.endswith("/"):
            continue
        if not (block or kind or name == "a"):
            continue
        article = name in ARTICLE and not kind
        if article:
            for x in noisy:
                if x.kind != COMMENTS and (x.inner is None or name == "main" and not x.main):
                    x.inner, x.main = len(found), name == "main"
        if kind:
            flush()
        stack.append(x := _Open(name, kind, article))
        many[name] += 1
        articles += article
        if kind:
            noisy.append(x)
    parts.append(html[at:])
    if many["a"]:
        linked += len(html) - at
    flush()
    while stack:
        pop(False)
    return [(t, w, inside, max((x.kind for x in xs if x.until is None or i < x.until), default=PLAIN)) for i, (t, w, inside, xs) in enumerate(found)]


def _plain(lines: list[tuple[str, int, bool, int]]) -> list[tuple[str, int, bool]]:
    """Lines that are not dropped, after containers that must be the page itself are taken back."""
    weight = lambda kind: sum(w for _, w, _, k in lines if k == kind)
    taken = {PLAIN, FORM} if weight(FORM) > weight(PLAIN) else {PLAIN}
    if not any(inside for _, _, inside, k in lines if k in taken):
        lines = [(t, w, inside, PLAIN if inside and k in (FORM, NOISY) else k) for t, w, inside, k in lines]
    if not any(w for _, w, _, k in lines if k in taken):
        taken |= {FORM, NOISY}
    return [(t, w, inside) for t, w, inside, k in lines if k in taken]


def main_text(html: str | None, window: int = WINDOW, threshold: int = THRESHOLD) -> str:
    """Lines between surge and dive points, joined by line feeds."""
    lines = _plain(page_lines(html or ""))
    more = -(-threshold // window)
    runs = [[(t, w + more if inside and w else w) for t, w, _ in run] for inside, run in groupby(lines, key=lambda x: x[2])]
    declared = [inside for inside, _ in groupby(lines, key=lambda x: x[2])]
    ahead = [[sum(w for _, w in run[i : i + window]) for i in range(len(run))] for run in runs]
    least = min(threshold, max((x for sums in ahead for x in sums), default=0) / 2)
    kept = []
    for inside, run, sums in zip(declared, runs, ahead, strict=True):
        running, on = False, []
        for i in range(len(run)):
            behind = sum(x for _, x in run[max(0, i - window + 1) : i + 1])
            running = sums[i] >= least and sums[i] > 0 or running and behind >= least
            on.append(running)
        kept += [text for (text, _), keep in zip(run, _whole(run, on, inside), strict=True) if keep]
    return "\n".join(kept)


def _whole(run: list[tuple[str, int]], on: list[bool], inside: bool) -> list[bool]:
    """Lines between surge and dive, after dives that are not made by links are taken back: from the first surge on, a stretch is cut only if
    most of its text is links. Outside an article, lines of links alone at a stretch's end go with the dive."""
    out, i = on[:], on.index(True) if True in on else len(on)
    while i < len(run):
        j = i
        while j < len(run) and on[j] == on[i]:
            j += 1
        if not on[i]:
            stretch = run[i:j]
            out[i:j] = [2 * sum(w for _, w in stretch) >= sum(len(t) for t, _ in stretch)] * (j - i)
        i = j
    if not inside:
        for i in range(len(run) - 1, -1, -1):
            if out[i] and not run[i][1] and (i + 1 == len(run) or not out[i + 1]):
                out[i] = False
    return out


@F.arrow_udf(T.StringType())
def _main_text(html: pa.Array) -> pa.Array:
    return pa.array([main_text(x) for x in html.to_pylist()], pa.string())


def extract(pages: DataFrame, html: str = "html", to: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html`` in column ``to``."""
    return pages.withColumn(to, _main_text(F.col(html)))


def main_text_column(html: Column) -> Column:
    return _main_text(html)
