"""Main text of web pages by tag-path ratios.

A page is read into text blocks, each with the path of tags from the root. Text length and
punctuation are aggregated per path; the ratios of text and of punctuation to the nodes of a
path are smoothed over its nearest paths in the tree, fused, and paths whose fused ratio
reaches the page's threshold are content. What an element's name or class says (navigation,
advert, article ...) is a weight in the fusion. Names that mean an element apart (nav, footer,
advert ...) weigh so much that they decide for texts that look like the article's; names that
often mean one only tip the scale; and no name of an element that holds a page's main heading and
nearly all of its text counts. Headings, list items, table cells and other blocks that are no sentences
follow the content that they stand beside.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of the HTML standard, by what they mean for the text.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
APART = {"nav", "header", "footer", "aside", "button", "select", "option", "label", "menu", "dialog", "svg", "math", "canvas", "audio", "video", "object", "applet", "head"}
NO_SENTENCE = {"h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "caption", "figcaption", "pre", "blockquote"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "center", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2",
    "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th", "tbody"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
}
SCOPE = {"table", "td", "th", "ul", "ol", "dl", "div", "article", "section", "main", "body", "html", "blockquote"}
# Words in class or id values: of elements apart from the article, of elements that often are,
# and of elements that hold it.
_WORDS = r"(?:^|[-_\s])(?:{})(?=$|[-_\s\d])"
APART_WORDS = re.compile(
    _WORDS.format(
        r"ads?|adverts?|advertisement|advertising|adsbygoogle|sponsor(?:ed|s)?|promo(?:tion|s)?|cookies?|consent|gdpr|popup|modal|newsletter|subscribe"
        r"|subscription|nav|navbar|navigation|menu|breadcrumbs?|pagination|sidebar|footer|copyright|comments?|commentlist|disqus|outbrain|taboola"
    ),
    re.I,
)
OFTEN_APART_WORDS = re.compile(
    _WORDS.format(
        r"banner|notice|alert|overlay|signup|sign-up|login|pager|side|widget|toolbar|header|masthead|foot|legal|disclaimer|respond|replies|reply|discussion"
        r"|share|sharing|social|related|recommend(?:ed|ations)?|trending|popular|tags?|skip|search"
    ),
    re.I,
)
ARTICLE_WORDS = re.compile(_WORDS.format(r"article|articlebody|post|entry|story|content|main|body|text"), re.I)
#: Weights of an element in the fusion; of those around a block, the least below one counts, and ARTICLE once.
APART_WEIGHT, OFTEN_APART_WEIGHT, ARTICLE_WEIGHT = 0.05, 0.5, 2.0
#: An element with the main heading and this share of a page's text outside links is the page itself: its name says nothing.
WHOLE_PAGE = 0.8
#: Smoothing: weight of the path above or below, and of one beside. A path is content from this share of the page's best ratio on,
#: and from LEAST on, which a few words apart from any article do not reach.
NEAR, BESIDE, SHARE, LEAST = 0.1, 0.05, 0.7, 0.5
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
WEIGHT = re.compile(r"!([\d.]+)$")


@dataclass
class Block:
    path: tuple[str, ...]  # steps: tag.classes, with !weight where it isn't one
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), next((g for g in m.groups()[1:] if g is not None), ""))
    return out


def _hidden(attrs: dict[str, str]) -> bool:
    if "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    return "style" in attrs and bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs["style"], re.I))


def _weight(tag: str, attrs: dict[str, str], inside_article: bool) -> float:
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}" if attrs else ""
    if tag in ("html", "body"):
        return 1.0
    if tag in ("main", "article"):
        return ARTICLE_WEIGHT
    if (tag in APART and not (tag == "header" and inside_article)) or attrs.get("role", "").lower() in ROLES or APART_WORDS.search(names):
        return APART_WEIGHT
    if tag == "form" or OFTEN_APART_WORDS.search(names):
        return OFTEN_APART_WEIGHT
    return ARTICLE_WEIGHT if ARTICLE_WORDS.search(names) else 1.0


def blocks(page: str) -> list[Block]:
    """Text blocks in page order, with their tag paths; character references are decoded."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool]] = []  # tag, its step in the path, hidden
    now: Block | None = None
    path: tuple[str, ...] | None = ()
    hidden = links = 0  # open elements that are not shown, and open links

    def end() -> None:
        nonlocal now
        now = None

    def add(text: str) -> None:
        nonlocal now, path
        if hidden:
            return
        if path is None:
            path = tuple(s for t, s, _ in stack if t not in INLINE or "!" in s)
        if now is not None and now.path != path:
            now = None  # an inline element with a weight of its own
        if now is None:
            if not text or text.isspace():
                return
            now = Block(path)
            out.append(now)
        now.parts.append(text)
        if links:
            now.linked += len(text)

    def push(tag: str, step: str, is_hidden: bool) -> None:
        nonlocal hidden, links, path
        stack.append((tag, step, is_hidden))
        hidden += is_hidden
        links += tag == "a"
        path = None

    def pop_to(index: int) -> None:
        nonlocal hidden, links, path
        for tag, _, is_hidden in stack[index:]:
            hidden -= is_hidden
            links -= tag == "a"
            if tag not in INLINE:
                end()
        del stack[index:]
        path = None

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            add(html.unescape(page[at:]))
            break
        if m.start() > at:
            add(html.unescape(page[at : m.start()]))
        at = max(m.end(), m.start() + 1)
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            index = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if index is not None and not (tag in INLINE and any(t in SCOPE for t, _, _ in stack[index + 1 :])):
                pop_to(index)
            elif tag in ("p", "br"):
                end()
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*/?>?", re.I).search(page, at)
            at = close.end() if close else n
            if tag not in INLINE:
                end()
            continue
        if tag in CLOSES_P or tag in CLOSED_BY:
            shut = CLOSED_BY.get(tag, set()) | ({"p"} | (HEADINGS if tag in HEADINGS else set()) if tag in CLOSES_P else set())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in shut:
                    pop_to(i)
                    if tag not in CLOSED_BY:
                        break
                elif stack[i][0] in SCOPE and stack[i][0] not in shut:
                    break
        if tag in VOID:
            if tag in ("br", "hr"):
                if tag == "br" and now is not None:
                    now.parts.append(" ")
                else:
                    end()
            continue
        if tag not in INLINE:
            end()
        attrs = _attributes(m[3]) if m[3] else {}
        inside = tag == "header" and any(t in ("article", "main") for t, _, _ in stack)
        names = ".".join(sorted(set(attrs["class"].lower().split()))) if attrs.get("class") else ""
        weight = _weight(tag, attrs, inside)
        push(tag, (f"{tag}.{names}" if names else tag) + (f"!{weight}" if weight != 1 else ""), bool(attrs) and _hidden(attrs))
    for b in out:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in out if b.text]


# ------------------------------------------------------------------ tag-path ratios
def _smooth(order: list[tuple[str, ...]], values: np.ndarray) -> np.ndarray:
    """Weighted means over each path, the one above, those right below and those beside."""
    place = {p: i for i, p in enumerate(order)}
    above = {}  # number and sum of the paths right below each one
    for p, v in zip(order, values):
        n, total = above.get(p[:-1], (0, 0.0))
        above[p[:-1]] = (n + 1, total + v)
    out = np.zeros(len(order))
    for i, (p, v) in enumerate(zip(order, values)):
        n, total = above[p[:-1]]
        below, sums = above.get(p, (0, 0.0)) if p else (0, 0.0)
        up = place.get(p[:-1]) if p else None
        weight = 1 + BESIDE * (n - 1) + NEAR * (below + (up is not None))
        out[i] = (v + BESIDE * (total - v) + NEAR * (sums + (values[up] if up is not None else 0.0))) / weight
    return out


def path_weight(path: tuple[str, ...], whole: set[tuple[str, ...]] = frozenset()) -> float:
    weights = [float(m[1]) for k, m in enumerate(map(WEIGHT.search, path), 1) if m and (float(m[1]) > 1 or path[:k] not in whole)]
    return min([1.0, *weights]) * max([1.0, *weights])


def whole_page(found: list[Block]) -> set[tuple[str, ...]]:
    """Paths of elements with a name against them that hold the main heading and WHOLE_PAGE of
    the page's text outside links."""
    chars: dict[tuple[str, ...], int] = {}
    headed, total = set(), 0
    for b in found:
        free = len(b.text) - min(b.linked, len(b.text))
        total += free
        for k, m in enumerate(map(WEIGHT.search, b.path), 1):
            if m and float(m[1]) < 1:
                chars[b.path[:k]] = chars.get(b.path[:k], 0) + free
                if any(step.split(".")[0].split("!")[0] == "h1" for step in b.path[k:]):
                    headed.add(b.path[:k])
    return {p for p in headed if chars[p] >= WHOLE_PAGE * total}


def fused_ratios(found: list[Block]) -> tuple[dict[tuple[str, ...], float], float]:
    """(fused ratio of each path, the page's threshold). A path has its text that is in no
    link and its punctuation marks for each node, both smoothed; their product on a logarithmic
    scale is weighed by the share of text in no link and by what the elements' names say. The
    threshold is a share of the best ratio, for which no name counts in favour."""
    order = list(dict.fromkeys(b.path for b in found))
    place = {p: i for i, p in enumerate(order)}
    nodes, chars, marks, linked = (np.zeros(len(order)) for _ in range(4))
    for b in found:
        i = place[b.path]
        nodes[i] += 1
        chars[i] += len(b.text)
        marks[i] += len(PUNCTUATION.findall(b.text))
        linked[i] += min(b.linked, len(b.text))
    text, points = _smooth(order, (chars - linked) / np.maximum(nodes, 1)), _smooth(order, marks / np.maximum(nodes, 1))
    free = 1 - linked / np.maximum(chars, 1)
    plain = np.log1p(text * (points + 0.3)) * free
    whole = whole_page(found)
    weight = np.array([path_weight(p, whole) for p in order])
    threshold = max(LEAST, SHARE * float((plain * np.minimum(weight, 1)).max(initial=0.0)))
    return dict(zip(order, (plain * weight).tolist())), threshold


def content_paths(found: list[Block]) -> set[tuple[str, ...]]:
    """Paths that reach the threshold, and paths of no sentences in the same element as one
    of them, unless their names speak against it or most of their text is in links."""
    (ratios, threshold), whole = fused_ratios(found), whole_page(found)
    keep = {p for p, v in ratios.items() if v >= threshold}
    around = {p[:-1] for p in keep}
    chars, linked = dict.fromkeys(ratios, 0), dict.fromkeys(ratios, 0)
    for b in found:
        chars[b.path] += len(b.text)
        linked[b.path] += min(b.linked, len(b.text))
    for p in ratios:
        plain = p and p[-1].split(".")[0].split("!")[0] in NO_SENTENCE and path_weight(p, whole) >= 1 and linked[p] < 0.6 * chars[p]
        if plain and any(p[:k] in around for k in range(len(p))):
            keep.add(p)
    return keep


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    paths = content_paths(found)
    return "\n".join(b.text for b in found if b.path in paths)


def extract_main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """`keep` columns with text (empty if none) and n_chars, a row per row of `pages`.

    A null or empty html gives an empty text; so does a page without article text. Broken
    markup is read as far as it goes. Repeated rows give a row each, an empty table none.
    """
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names[:-1], "text", "n_chars"]
            )

    names = [c for c in keep if c in kinds]
    schema = "".join(f"`{c}` {kinds[c]}, " for c in names) + "text string, n_chars bigint"
    return pages.select(*names, html_col).mapInArrow(run, schema)
