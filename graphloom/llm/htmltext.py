"""Main text of web pages by the distribution of text over blocks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .storage import free_name

WINDOW_LINES = 3
SURGE_CHARS = 86
ARTICLE, MAIN = "article", "main"

# Elements of the HTML standard, and names that sites give to what surrounds an article.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend",
    "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
    "caption", "head", "noscript", "template",
}
ASIDE = {
    "head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "search", "script", "style", "noscript", "template",
    "textarea", "title", "xmp", "iframe", "noembed", "noframes", "svg", "math", "canvas", "object", "audio", "video", "select",
    "button", "input", "datalist", "map",
}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
ASIDE_NAMES = {
    "ad", "ads", "adsbygoogle", "adslot", "adunit", "advert", "advertisement", "advertising", "adverts", "banner", "breadcrumb",
    "breadcrumbs", "byline", "comment", "commentlist", "comments", "consent", "cookie", "cookies", "copyright", "disqus", "feedback",
    "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "notices", "notification", "overlay", "pager", "pagination", "paywall", "popup", "privacy", "promo", "promotion", "recommended",
    "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor",
    "sponsored", "subscribe", "subscription", "teaser", "toolbar", "topbar", "widget",
}

# Words that only say what kind of box a named part is, as in "related-posts" or "ad-slot-top".
BOX_NAMES = {
    "area", "article", "articles", "bar", "block", "bottom", "box", "button", "buttons", "container", "content", "count", "entry", "form",
    "group", "holder", "icon", "icons", "in", "inline", "inner", "item", "items", "left", "link", "links", "list", "media", "module",
    "outer", "page", "panel", "post", "posts", "right", "row", "section", "site", "slot", "stories", "story", "this", "title", "top",
    "unit", "wrap", "wrapper",
}
PROSE = {"h1", "h2", "h3", "h4", "h5", "h6", "p"}

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[!?/a-zA-Z][^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_ARTICLE = re.compile(r"<article[\s>/]", re.I)
_MAIN = re.compile(r"<main[\s>/]|role\s*=\s*[\"']?main\b", re.I)
_ROLE_MAIN = re.compile(r"role\s*=\s*[\"']?main\b", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAME = re.compile(r"[a-z]+")
_CASE = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Line:
    """A block's text, in the page's order; none of it for blocks that are not part of an article."""

    parts: list[str] = field(default_factory=list)
    prose: bool = False  # a heading or paragraph
    linked: int = 0
    inside: bool = False
    dropped: bool = False

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _is_aside(name: str, attributes: str, in_article: bool) -> bool:
    if name in ASIDE and not (name == "header" and in_article):
        return True
    if not attributes.strip(" /"):
        return False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), unescape("".join(values))
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            return True
        if key == "role" and value.lower() in ASIDE_ROLES:
            return True
        if key in ("class", "id") and name not in ("html", "body", "article", "main") and _names_part(name, key, value, in_article):
            return True
    return False


def _names_part(name: str, key: str, value: str, in_article: bool) -> bool:
    """Whether a class or id names a part of the site.

    In an article, and on headings and paragraphs, a whole token must: no word
    of it may be of another kind.  Ids of headings and paragraphs are slugs of
    their text, and headers of an article are part of it.
    """
    if name in PROSE and key == "id":
        return False
    for token in value.split():
        words = set(_NAME.findall(_CASE.sub(" ", token).lower()))
        parts = words & ASIDE_NAMES
        if in_article:
            parts.discard("header")
        if parts and (words <= ASIDE_NAMES | BOX_NAMES or not (in_article or name in PROSE)):
            return True
    return False


def page_lines(html: str) -> tuple[list[Line], bool]:
    """The page's blocks, and whether the page marks its article.

    It does where an article element, or else a main element, that is no part
    of a sidebar or the like holds text; comments and scripts open none.  An
    article that holds links only marks nothing where the text outside links
    is that of an article without it.
    """
    found = None
    for kind, sign in ((ARTICLE, _ARTICLE), (MAIN, _MAIN)):
        if sign.search(html):
            lines = _lines(html, kind)
            inside = [line for line in lines if line.inside]
            if any(len(line.text()) > line.linked for line in inside):
                return lines, True
            if inside:
                found = found or lines
    lines = _lines(html, None)
    if found and max(_sums(_unlinked([line for line in lines if line.text()]), WINDOW_LINES), default=0) < SURGE_CHARS:
        return found, True
    return lines, False


def _unlinked(lines: list[Line]) -> list[int]:
    return [max(0, len(line.text()) - line.linked) for line in lines]


def _sums(weights: list[int], window: int) -> list[int]:
    return [sum(weights[i : i + window]) for i in range(len(weights))]


def _lines(html: str, kind: str | None) -> list[Line]:
    """The page's blocks, those in an element of the ``kind`` marked as inside.

    Markup, comments and raw-text elements are stripped; what stands in a
    menu, header, footer, sidebar, notice, advert, form, hidden element or
    reader comments leaves empty lines.  An element left open ends with the
    one around it.
    """
    lines = [Line()]
    stack: list[tuple[str, bool, bool]] = []  # name, aside, article
    opened: Counter[str] = Counter()
    at, aside, article, links = 0, 0, 0, 0

    def text(piece: str) -> None:
        line = lines[-1]
        if aside or not piece:
            line.dropped |= bool(piece.strip())
            return
        decoded = unescape(piece)
        line.parts.append(decoded)
        line.inside |= article > 0 and not decoded.isspace()
        if links and not (article and line.prose):
            line.linked += len(decoded.strip())

    def pop(to: int) -> None:
        nonlocal aside, article, links
        while len(stack) > to:
            name, was_aside, was_article = stack.pop()
            opened[name] -= 1
            aside -= was_aside
            article -= was_article
            links -= name == "a"

    while at < len(html):
        found = _TOKEN.search(html, at)
        if not found:
            text(html[at:])
            break
        text(html[at : found.start()])
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        closing, attributes = found[1] or found[4], found[3] or found[6] or ""
        if name in BLOCK:
            lines.append(Line(prose=not closing and name in PROSE))
        elif name in ("br", "td", "th") and not aside:
            lines[-1].parts.append(" ")
        if closing:
            if opened[name]:  # a stray end tag closes nothing, and no stack is searched for it
                pop(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            continue
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in BLOCK and stack and stack[-1][0] in ("head", "p") and name not in ("noscript", "template"):
            pop(len(stack) - 1)
        if name == "body":
            while stack and stack[-1][0] == "head":
                pop(len(stack) - 1)
        is_aside = _is_aside(name, attributes, article > 0)
        is_article = not is_aside and (name == kind or kind == MAIN and bool(_ROLE_MAIN.search(attributes)))
        if attributes.endswith("/") and name in ("svg", "math", "path"):
            continue
        stack.append((name, is_aside, is_article))
        opened[name] += 1
        aside += is_aside
        article += is_article
        links += name == "a"
    return lines


def main_text(html: str | None, window: int = WINDOW_LINES, surge: int = SURGE_CHARS) -> str:
    """The article's blocks, white space in each made one space, joined by newlines.

    Each line weighs its text outside links, and nothing where the page marks
    its article and the line lies outside.  A heading or paragraph of a marked
    article weighs all its text, as does a marked article of links only.  Sums
    over ``window`` lines find where text surges from nothing and where it
    dives to nothing.  The text lies between the first surge and the last dive
    of those stretches that reach ``surge`` characters, or of all stretches
    where none does or the article is marked; so link lists before and after
    the text of an article go and those within it stay.  On unmarked pages
    lines that hold nothing at all, as nested tags make them, don't count, and
    what weighs nothing between two stretches is left out.  A stretch begins
    with its first line of weight, or a heading or paragraph in the window
    before it; its lines are kept whole.  Null, empty and text-free pages give "".
    """
    lines, marked = page_lines(html or "")
    if marked:
        lines = [line for line in lines if line.inside]
    else:
        lines = [line for line in lines if line.dropped or line.text()]
    texts = [line.text() for line in lines]
    weights = _unlinked(lines)
    if marked and not any(weights):
        weights = [len(t) for t in texts]
    sums = _sums(weights, window)
    stretches, start = [], None
    for i, total in enumerate([*sums, 0]):
        if total and start is None:
            start = i
        elif not total and start is not None:
            stretches.append((start, i))
            start = None
    dense = [k for k, (a, b) in enumerate(stretches) if marked or max(sums[a:b]) >= surge]
    kept = stretches[dense[0] : dense[-1] + 1] if dense else stretches
    if marked and kept:
        kept = [(kept[0][0], kept[-1][1])]
    kept = [(next((i for i in range(a, b) if weights[i] or lines[i].prose), b), b) for a, b in kept]
    return "\n".join(t for a, b in kept for t in texts[a:b] if t)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without ``html``, with ``text`` and ``n_chars`` (its code points).

    Pages are parsed one by one, whole.  Repeated rows give repeated rows; a
    clashing name keeps its column and the new one gets underscores in front.
    """
    rest = [c for c in pages.columns if c != html]
    ordered = pages.select(html, *rest)
    names = [free_name(ordered.drop(html), n) for n in ("text", "n_chars")]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema if f.name != html]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [main_text(h.as_py()) for h in batch.column(0)]
                columns = [*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*rest, *names])

    return ordered.mapInArrow(parse, ", ".join([*fields, f"`{names[0]}` string, `{names[1]}` long"]))
