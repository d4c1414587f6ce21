"""Main text of web pages by tag-path ratios.

Per page, text blocks are grouped by their path of block tags from the root to the leaf. A path's
text ratio is its characters per block, its punctuation ratio the punctuation marks per block.
Both are smoothed with the ratios of the section that the path lies in (its nearest element that
is no paragraph, heading, list, table or quote), all paths below included: so a list item of an
article has the article's ratios in its score, and a short block in a section of its own
has not. Headings have the section's ratios alone. They are fused into one score, times the share of text outside links, times a factor for
names: article and main elements raise it, classes and ids that speak of adverts, notices, comments
and the like lower it. A path is content if its score reaches THRESHOLD times that of the section
that holds most text.

Names alone decide nothing but for the elements that are by definition no article text: menus,
headers outside an article, footers, sidebars, forms (and the ARIA roles that stand for them), scripts,
styles and what is hidden.

Defined results: null, empty or tag-only html gives an empty text; unclosed tags, comments,
quotes and cut-off pages are read as far as they go; of long pages nothing is cut, and elements may
lie in each other to any depth.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .common import plain

# Element names by their role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = "script|style|textarea|title|svg|math|iframe|noembed|noframes|noscript|template|xmp|select|button|object|canvas|audio|video"
_INLINE = frozenset("a abbr acronym b bdi bdo big blink cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr center".split())
_EXCLUDED = frozenset("nav footer aside form menu dialog head fieldset".split())
#: ARIA roles of the same meaning.
_EXCLUDED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog".split())
_CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
_SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LIST_SCOPE = frozenset("ul ol dl table div section article main body nav aside footer header".split())
#: Words of class, id and role names that mark what is no article text.
_BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer gdpr "
    "login masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promotion related reply replies "
    "search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget complementary contentinfo alert dialog".split()
)
#: A name with one of these tells of what its element goes with, not of what it is.
_BESIDE_WORDS = frozenset("has with without no is free".split())
_CONTAINERS = frozenset(("article", "main"))
#: Elements of running text; the nearest other element is the section.
_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary hgroup header".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    r"(?P<comment><!--(?:(?!-->)[\s\S])*+(?:-->|\Z))"
    rf"|<(?P<raw>{_RAW})\b(?P<rawattrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>(?:(?!</(?P=raw)\b)[\s\S])*+(?:</(?P=raw)\b[^>]*+>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)",
    re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_PUNCTUATION = re.compile(r"[.,;:!?…、。؟،，！？]")
#: Paths whose score is at least this share of the main section's are content.
THRESHOLD = 0.4
#: Factors of a score: for paths in an article or main element, and for paths through an element of a telltale name.
GOOD, BAD = 1.5, 0.1


class Paths:
    """A page's paths as a tree: a node is a path, numbered after its parent; node 0 is the empty path.

    A node knows what its path holds (an article's container, a telltale name, an excluded element)
    and its section, so nothing walks up a path and broken pages of any depth take linear time.
    """

    def __init__(self) -> None:
        self.parent, self.label, self.section = [0], [""], [0]
        self.article, self.telltale, self.excluded = [False], [False], [False]
        self._known: dict[tuple[int, str], int] = {}

    def child(self, node: int, label: str) -> int:
        """The node of node's path with one more label."""
        if (found := self._known.get((node, label))) is not None:
            return found
        new = self._known[node, label] = len(self.parent)
        self.parent.append(node)
        self.label.append(label)
        self.section.append(self.section[node] if label.rstrip("+~-") in _FLOW else new)
        for marks, mark in ((self.article, "+"), (self.telltale, "~"), (self.excluded, "-")):
            marks.append(marks[node] or label[-1] == mark)
        return new

    def path(self, node: int) -> tuple[str, ...]:
        labels = []
        while node:
            labels.append(self.label[node])
            node = self.parent[node]
        return tuple(reversed(labels))

    def factor(self, node: int) -> float:
        return (GOOD if self.article[node] else 1.0) * (BAD if self.telltale[node] else 1.0)


def _telltale(value: str, tag: str) -> bool:
    """Whether a class or id name speaks of what is no article text; in running text most of its words must."""
    words = [w.lower() for w in _NAME_WORDS.findall(value)]
    bad = sum(w in _BAD_WORDS for w in words)
    return bad > 0 and not _BESIDE_WORDS.intersection(words) and (tag not in _FLOW or 2 * bad >= len(words))


def _label(name: str, attrs: str, in_article: bool) -> str:
    """An element's part of a path: its tag; outside running text its classes too, so that sections differ; at last its mark.

    Marks: '-' for an element that holds no article text by definition, '+' for an article's
    container, '~' for a telltale name.
    """
    if name in _EXCLUDED or name == "header" and not in_article:
        return name + "-"
    if not attrs.strip():
        return name + "+" * (name in _CONTAINERS)
    tag, found = name, {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attrs)}
    role = found.get("role", "").lower()
    if role in _EXCLUDED_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.IGNORECASE):
        return name + "-"
    if name not in _FLOW and found.get("class"):
        name = f"{name}.{found['class']}|"
    if any(_telltale(x, tag) for x in (found.get("class", "") + " " + found.get("id", "")).split()):
        return name + "~"
    return name + "+" * (tag in _CONTAINERS or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody")


def page_tree(page: str) -> tuple[Paths, list[tuple[int, str, int]]]:
    """The page's paths, and its text blocks in page order: (node, text, characters inside links)."""
    paths, out, parts = Paths(), [], []
    stack: list[tuple[str, int]] = []  # open elements: (name, node)
    open_at: dict[str, list[int]] = defaultdict(list)  # where each name is in the stack
    scopes: list[int] = []  # where elements are that a list item's or cell's end does not pass
    links, in_link, node = 0, 0, 0

    def flush() -> None:
        nonlocal links
        if parts and (text := " ".join("".join(parts).split())):
            out.append((node, text, min(links, len(text))))
        parts.clear()
        links = 0

    def close(to: int) -> None:
        nonlocal node
        flush()
        while len(stack) > to:
            open_at[stack.pop()[0]].pop()
        while scopes and scopes[-1] >= to:
            scopes.pop()
        node = stack[-1][1] if stack else 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text = _html.unescape(page[at : m.start()])
            parts.append(text)
            if in_link:
                links += len(text.strip())
        at = m.end()
        if m["comment"] or m["raw"] or not m["name"]:
            if m["raw"] and not re.match("button|noscript", m["raw"], re.IGNORECASE):
                flush()
            continue
        name, end = m["name"].lower(), m["end"]
        if name == "br" or name == "hr":
            parts.append(" ")
        elif name == "a":
            in_link = 0 if end else 1
        elif name in _INLINE or name in _VOID:
            pass
        elif end:
            if open_at[name]:
                close(open_at[name][-1])
                in_link = 0
            else:
                flush()
        else:
            flush()
            if stack and stack[-1][0] in _CLOSED_BY_BLOCK:
                close(len(stack) - 1)
            if name in _SAME_CLOSES:
                same = max((open_at[x][-1] for x in _SAME_CLOSES[name] if open_at[x]), default=-1)
                if same > (scopes[-1] if scopes else -1):
                    close(same)
            in_link = 0
            node = paths.child(node, _label(name, m["attrs"], paths.article[node]))
            open_at[name].append(len(stack))
            if name in _LIST_SCOPE:
                scopes.append(len(stack))
            stack.append((name, node))
    if at < len(page):
        parts.append(_html.unescape(page[at:]))
    flush()
    return paths, out


def blocks_of(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """Text blocks in page order with their paths written out: (labels, text, characters inside links)."""
    paths, blocks = page_tree(page)
    return [(paths.path(node), text, links) for node, text, links in blocks]


def _fused(chars: float, marks: float, links: float) -> float:
    return (1 - links) * (chars * (1 + marks)) ** 0.5


def node_scores(paths: Paths, blocks: list[tuple[int, str, int]]) -> tuple[dict[int, float], float]:
    """Score per path that may hold content, and that of the section with most text (of equal ones the first)."""
    sums: dict[int, list[float]] = defaultdict(lambda: [0, 0, 0, 0])  # blocks, characters, punctuation, characters in links
    for node, text, links in blocks:
        if not paths.excluded[node]:
            s = sums[node]
            for i, v in enumerate((1, len(text), len(_PUNCTUATION.findall(text)), links)):
                s[i] += v
    own: dict[int, list[float]] = defaultdict(lambda: [0, 0, 0, 0])
    below = [[0.0, 0.0, 0.0] for _ in paths.parent]
    for node, s in sums.items():
        section, weight = paths.section[node], BAD if paths.telltale[node] else 1.0
        for i in range(4):
            own[section][i] += s[i]
        for i, v in enumerate((s[0], s[1] - s[3], s[2])):
            below[section][i] += weight * v
    for node in range(len(below) - 1, 0, -1):  # children come after their parents
        up = below[paths.parent[node]]
        for i, v in enumerate(below[node]):
            up[i] += v
    main = max(own, key=lambda c: paths.factor(c) * (own[c][1] - own[c][3]), default=None)
    if main is None:
        return {}, 0.0
    n, chars, marks, links = own[main]
    best = paths.factor(main) * _fused(chars / n, marks / n, links / chars)
    out = {}
    for node, (n, chars, marks, links) in sums.items():
        section = paths.section[node]
        smooth, around = 0.5, [below[section]]
        if paths.label[node].rstrip("+~-") in _HEADINGS:  # of any length, and maybe wrapped by itself
            smooth, around = 1.0, around + [below[paths.section[paths.parent[section]]]] * bool(section)
        all_n, all_chars, all_marks = max(around, key=lambda s: s[1] / s[0])
        text_ratio, mark_ratio = ((1 - smooth) * x / n + smooth * y / all_n for x, y in ((chars, all_chars), (marks, all_marks)))
        out[node] = paths.factor(node) * _fused(text_ratio, mark_ratio, links / chars)
    return out, best


def path_scores(blocks: list[tuple[tuple[str, ...], str, int]]) -> tuple[dict[tuple[str, ...], float], float]:
    """node_scores of blocks whose paths are written out."""
    paths, numbered = Paths(), []
    for path, text, links in blocks:
        node = 0
        for label in path:
            node = paths.child(node, label)
        numbered.append((node, text, links))
    scores, best = node_scores(paths, numbered)
    return {paths.path(node): score for node, score in scores.items()}, best


def main_text(page: str | None) -> str:
    """The page's main text; empty if there is none."""
    paths, blocks = page_tree(page or "")
    scores, best = node_scores(paths, blocks)
    return " ".join(text for node, text, _ in blocks if node in scores and scores[node] >= THRESHOLD * best)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per page: page_id, url, text, n_chars (code points of the text)."""
    kind = dict(pages.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [main_text(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select(plain(id_col).alias("page_id"), plain(url_col).alias("url"), plain(html_col).alias("html")).mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")
