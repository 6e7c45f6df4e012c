"""Main text of web pages by composite text density (operator 5).

Each page becomes a tree of elements; what is never article text (scripts, menus, footers, forms,
adverts, comments and the like, by tag, role, class or id) is left out. For every node, with C
characters in T tags below it, of which LC and LT are in links,

    density = C/T * log_b(C/LC * T/LT),   b = ln(C/(C-LC) * LC + LC_body/C_body * C + e)

(no link characters or tags count as one). The density sum of a node adds up its children's
densities. The node of the greatest sum is the article's core, and the least density on the path from
it to the body is the threshold: every node that reaches it contributes the subtree of greatest
density sum below it. This decides every page. The outermost ``article`` around a contributed node, or
``main`` where there is none, then adds what is too short to be dense, titles and short blocks; a
block of several links that make up the larger part of its text is not added.

Pages without either tag grow the same way from what the densities chose: short blocks between its
parts belong to it; the element around it takes in its other children while they are text rather
than links; and where they are not, or the page itself is reached, what stands between the nearest
heading before it and the text, title and lead, is added.

A class or id speaks of furniture by any word in it, but inside an ``article`` or ``main`` only if it
says nothing else: there ``social-history`` or ``search-for-life`` name a subject.
"""

from __future__ import annotations

import html
import re
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import own

RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = RAW | set("head nav footer aside button select input svg canvas object dialog menu map audio video".split())
BLOCKS = set(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th"
    " thead tr ul".split()
)
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Words of class and id names: an element so named is no part of an article ...
NOISE = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr popup modal"
    " comment comments disqus reply replies newsletter subscribe share sharing social related recommended"
    " breadcrumb breadcrumbs pagination pager login signup notice notices notification".split()
)
# ... nor is one named so, both unless it holds the article, as a form or a role does too.
FRAME = set("sidebar nav navbar navigation menu header footer masthead banner widget widgets search toolbar aside".split())
# Words that may stand beside those in a name without naming a subject.
FILLER = set(
    "area bar block body bottom box button buttons card column container content footer form grid header inline inner item items"
    " label left line link links list main module more outer panel post posts primary right row secondary section site slot"
    " stories story top unit wrap wrapper zone".split()
)
HEADINGS = {"h1", "h2", "h3"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
           "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th"}}
_HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
          "option": {"select"}, "tbody": {"table"}}
_TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|</?([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|</?[a-zA-Z][^>]*+\Z""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Tree:
    """Elements in page order: tag, parent, noise marks; and texts with the element they stand in."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.attributes = ["html"], [-1], [""]
        self.texts: list[tuple[int, str]] = []  # (element, text), in page order
        stack, open_ = [0], {}
        at = 0
        search = _TOKEN.search
        while (m := search(source, at)) is not None:
            if m.start() > at:
                self.texts.append((stack[-1], source[at : m.start()]))
            at = m.end()
            name = m[2] or m[4]
            if not name:
                continue
            name = name.lower()
            if m[1] or source.startswith("</", m.start()):
                if open_.get(name):
                    while True:
                        gone = self.tag[stack.pop()]
                        open_[gone] -= 1
                        if gone == name:
                            break
                continue
            if name in ("html", "body") and (name == "html" or open_.get("body")):
                continue
            self._close_implied(name, stack, open_)
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.attributes.append(m[3] if m[2] else m[5])
            if name in BLOCKS:
                self.texts.append((node, ""))  # a block without text of its own still parts its surroundings
            if name in VOID:
                if name == "br":
                    self.texts.append((stack[-1], " "))
                continue
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            stack.append(node)
            open_[name] = open_.get(name, 0) + 1
        if at < len(source):
            self.texts.append((stack[-1], source[at:]))

    def _close_implied(self, name: str, stack: list[int], open_: dict[str, int]) -> None:
        """A block ends an open paragraph, an item the item before it."""
        closes = {"p"} if name in BLOCKS else set()
        holds = _HOLDS.get(name, set())
        closes = closes | _CLOSES.get(name, set())
        if not any(open_.get(c) for c in closes):
            return
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[depth]]
            if tag in closes:
                for gone in stack[depth:]:
                    open_[self.tag[gone]] -= 1
                del stack[depth:]
                return self._close_implied(name, stack, open_)
            if tag in holds or tag in ("div", "article", "section", "main", "td", "th", "table", "body"):
                return

    def noise(self) -> list[bool]:
        """Elements that are no article text, themselves or by an ancestor.

        What a name, role or form tag says does not count for an element that is or holds the
        article: an article or main not named so itself, a first-level heading, or, on a page with
        no such article or main, any article or main or the larger part of the text outside links.
        """
        n = len(self.tag)
        marks = [_marks(a) if a.strip() else (False, False, False, False) for a in self.attributes]
        plain = any(self.tag[i] in ("article", "main") and not (marks[i][0] or marks[i][1]) for i in range(1, n))
        holds = [False] * n
        for i in range(n - 1, 0, -1):
            if self.tag[i] == "h1" or (self.tag[i] in ("article", "main") and not (plain and (marks[i][0] or marks[i][1]))):
                holds[i] = True
            if holds[i]:
                holds[self.parent[i]] = True
        unlinked: list[int] = []
        inside, told = [False] * n, [False] * n  # of an article; of an article or main
        out = [False] * n
        for i in range(1, n):
            up, tag = self.parent[i], self.tag[i]
            inside[i] = inside[up] or tag == "article"
            told[i] = told[up] or tag in ("article", "main")
            hidden, named, framed, only = marks[i]
            if told[up] and not only:
                named = framed = False
            out[i] = out[up] or tag in DROPPED or (tag == "header" and not inside[up])
            if out[i] or tag == "body":
                continue
            out[i] = hidden
            if not hidden and (named or framed or tag == "form") and not holds[i]:
                if not plain and not unlinked:
                    unlinked = self._unlinked(marks)
                out[i] = plain or 2 * unlinked[i] <= unlinked[0]
        return out

    def _unlinked(self, marks: list[tuple[bool, bool, bool, bool]]) -> list[int]:
        """Characters of text outside links, menus and hidden elements, for each element."""
        n = len(self.tag)
        skip, size = [False] * n, [0] * n
        for i in range(1, n):
            skip[i] = skip[self.parent[i]] or self.tag[i] in DROPPED or self.tag[i] == "a" or marks[i][0]
        for node, text in self.texts:
            if not skip[node]:
                size[node] += len("".join(text.split()))
        for i in range(n - 1, 0, -1):
            size[self.parent[i]] += size[i]
        return size


def _marks(attributes: str) -> tuple[bool, bool, bool, bool]:
    """Whether an element is hidden; named as noise; named or by its role part of the frame; and whether a
    name says only that: an id of that one word, a class of such words."""
    hidden = named = framed = only = False
    seen = set()
    for m in _ATTRIBUTE.finditer(attributes):
        what = m[1].lower()
        if what in seen or what not in ("class", "id", "role", "hidden", "aria-hidden", "style"):
            continue
        seen.add(what)  # of a repeated attribute the first counts
        value = html.unescape((m[2] or "").strip("\"'")).lower()
        if what in ("class", "id"):
            words = set(re.split(r"[^a-z]+", value))
            named = named or bool(words & NOISE)
            framed = framed or bool(words & FRAME)
            for token in value.split():
                said = set(re.split(r"[^a-z0-9]+", token)) - {""}
                meant = said & (NOISE | FRAME)
                only = only or bool(meant and (said <= NOISE | FRAME | FILLER if what == "class" else said == meant and len(said) == 1))
        elif what == "role":
            framed, only = framed or value in ROLES, only or value in ROLES
        else:
            hidden = hidden or what == "hidden" or (what == "aria-hidden" and value == "true")
            hidden = hidden or bool(what == "style" and _HIDDEN.search(value))
    return hidden, named, framed, only


def main_text(source: str | None) -> str:
    """Blocks of the article, one to a line."""
    if not source:
        return ""
    tree = Tree(source)
    out = tree.noise()
    n = len(tree.tag)
    chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = tree.tag[i] == "a" or in_link[tree.parent[i]]
    texts = [(node, html.unescape(t)) for node, t in tree.texts if not out[node]]
    for node, text in texts:
        size = len("".join(text.split()))
        chars[node] += size
        if in_link[node]:
            links[node] += size
    for i in range(n - 1, 0, -1):
        if not out[i]:
            up = tree.parent[i]
            chars[up] += chars[i]
            links[up] += links[i]
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + (tree.tag[i] == "a")
    if not chars[0]:
        return ""
    ratio = links[0] / chars[0]

    def density(i: int) -> float:
        c, lc, t, lt = chars[i], links[i], max(tags[i], 1), max(link_tags[i], 1)
        if not c:
            return 0.0
        base = log(c / max(c - lc, 1) * lc + ratio * c + e)
        return c / t * max(log(c / max(lc, 1) * t / lt), 0.0) / max(base, 1e-9)

    dense = [0.0 if out[i] else density(i) for i in range(n)]
    sums, leaf = [0.0] * n, [True] * n
    for i in range(n - 1, 0, -1):
        if not out[i]:
            if leaf[i]:
                sums[i] = dense[i]  # a node without children stands for itself
            sums[tree.parent[i]] += dense[i]
            leaf[tree.parent[i]] = False
    core = max(range(n), key=lambda i: (sums[i], -i))
    threshold, i = dense[core], core
    while i > 0 and tree.tag[i] != "body":
        i = tree.parent[i]
        threshold = min(threshold, dense[i])
    best = list(range(n))  # subtree of greatest sum at or below each node
    for i in range(n - 1, 0, -1):
        up = tree.parent[i]
        if not out[i] and sums[best[i]] > sums[best[up]]:
            best[up] = best[i]
    chosen = [False] * n
    for i in range(n):
        if not out[i] and chars[i] and dense[i] >= threshold:
            chosen[best[i]] = True
    for i in range(1, n):
        chosen[i] = not out[i] and (chosen[i] or chosen[tree.parent[i]])
    _add_short(tree, out, chars, links, link_tags, chosen)
    return "\n".join(_blocks(tree, texts, chosen))


def _add_short(
    tree: Tree, out: list[bool], chars: list[int], links: list[int], link_tags: list[int], chosen: list[bool]
) -> None:
    """Add to ``chosen`` the rest of the article and main elements that hold chosen text, without
    blocks of links."""
    n = len(tree.tag)
    article, main = [0] * n, [0] * n  # the outermost around each element
    for i in range(1, n):
        up, tag = tree.parent[i], tree.tag[i]
        article[i] = article[up] or (i if tag == "article" else 0)
        main[i] = main[up] or (i if tag == "main" else 0)
    with_text = {node for node, text in tree.texts if text.strip()}
    hold = {article[i] or main[i] for i in with_text if chosen[i]} - {0}
    if not hold:
        _grow(tree, out, chars, links, link_tags, chosen)
        return
    added = [False] * n
    for i in range(1, n):
        if out[i]:
            continue
        of_links = tree.tag[i] in BLOCKS and link_tags[i] > 1 and 2 * links[i] > chars[i]
        added[i] = i in hold or (added[tree.parent[i]] and not of_links)
        # A main holds what is in it but not in an article; its articles answer for themselves.
        if tree.tag[i] == "article" and article[i] == i and i not in hold:
            added[i] = False
    for i in range(1, n):
        chosen[i] = chosen[i] or added[i]


def _grow(
    tree: Tree, out: list[bool], chars: list[int], links: list[int], link_tags: list[int], chosen: list[bool]
) -> None:
    """Add to ``chosen`` what belongs to it on a page whose article no tag marks. Elements are in page
    order, so the elements inside one follow it."""
    n = len(tree.tag)
    in_links, end = [False] * n, list(range(1, n + 1))
    for i in range(1, n):
        in_links[i] = in_links[tree.parent[i]] or (tree.tag[i] in BLOCKS and link_tags[i] > 1 and 2 * links[i] > chars[i])
    for i in range(n - 1, 0, -1):
        end[tree.parent[i]] = max(end[tree.parent[i]], end[i])

    def picked() -> set[int]:
        return {node for node, words in tree.texts if chosen[node] and words.strip()}

    def add(low: int, high: int) -> None:
        for i in range(low, high):
            chosen[i] = chosen[i] or not (out[i] or in_links[i])

    found = picked()
    if not found:
        return
    low, high = min(found), max(found)
    add(low, high)
    around = low
    while end[around] <= high:
        around = tree.parent[around]
    while around > 0 and tree.tag[tree.parent[around]] not in ("body", "html"):
        up = tree.parent[around]
        others = chars[up] - chars[around]
        if 2 * (links[up] - links[around]) > others:
            break
        if others:
            add(up, end[up])
        around = up
    low = min(picked())
    heads = [i for i in range(n) if tree.tag[i] in HEADINGS and chars[i] and not (out[i] or in_links[i]) and i <= low]
    if heads and not chosen[heads[-1]] and not any(in_links[i] and chars[i] and not out[i] for i in range(heads[-1], low)):
        add(heads[-1], low)


def _blocks(tree: Tree, texts: list[tuple[int, str]], chosen: list[bool]) -> list[str]:
    """Texts of the chosen elements; a new block starts wherever the innermost block element changes."""
    block = [0] * len(tree.tag)
    for i in range(1, len(tree.tag)):
        block[i] = i if tree.tag[i] in BLOCKS else block[tree.parent[i]]
    blocks, now, parts = [], None, []
    for node, text in texts:
        if not chosen[node]:
            continue
        if block[node] != now:
            blocks.append("".join(parts))
            now, parts = block[node], []
        parts.append(text)
    blocks.append("".join(parts))
    return [b for b in (" ".join(x.split()) for x in blocks) if b]


def _extract(batches):
    for batch in batches:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def articles(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars (code points of text).

    A null or empty html and a page without article text give an empty text. Null ids and urls and
    repeated rows are kept; other columns are ignored.
    """
    rows = own(pages, "page_id", "url", "html")
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars bigint")


#: The same for the layout of the given pages, where the article is marked as such and holds
#: paragraphs and a heading.
PAGES_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|<footer>|$)', 1, 's') AS h FROM pages),
b AS (
  SELECT page_id, url, list_transform(string_split_regex(h, '</?(p|h1)>'),
    lambda x: replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*(>|$)', '', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&')) AS l FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(list_transform(l,
    lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM c
"""
