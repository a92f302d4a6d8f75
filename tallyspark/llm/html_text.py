"""Main text of web pages by tree scoring.

A page becomes a tree of elements.  Every text block (a paragraph, cell, list item, or loose
text of a container) earns points for its length and its commas and passes them on: all to its
parent, half to the grandparent, a third, a sixth, ... further up.  A container's sum is
weighted by its tag and name and discounted by its link density (link characters by all
characters).  The best container is kept, with siblings that score at least a fifth of it and
sibling paragraphs and headings that are prose.  Menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments are taken out before by element, role and
name.  A form with little prose goes, one around an article stays without its controls, and so does
a noscript part.

Names weigh; what they take out depends on the prose.  A name counts if all its words are of that
kind or neutral (``related-posts``, not ``related-work``), and not in names of layout (``no-sidebar``).
An element so named goes if no name beside it is a likely one and if it holds at most half of the
points of the page without its reader comments; these go where anything else is left to read.  Headings
and inline elements never go by their names, and an ``article`` or ``main`` only as a comment.
Lists of links go outside the best container.  What stands between two kept siblings stays if it is no
link list and bears no such name, and so does a part of headings before the best container.

Output: the kept blocks in page order, character references decoded, white space inside a block
(line breaks included) as one space, trimmed, empty blocks left out, joined by two line feeds.

Nulls and empty pages give an empty text, as do pages without any text.  A page that is no
markup is one block.  Repeated rows each get a row; an empty table gives none.  Input columns
named ``text`` or ``n_chars`` are replaced, others stay.  Broken nesting, unclosed elements,
comments and scripts at the end of the page are closed there.  A task holds one Arrow batch of
pages; a page is read in one pass and in time in proportion to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructType

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never article text.
SKIPPED = frozenset(
    "head script style template nav footer aside button select option textarea iframe "
    "svg object canvas audio video dialog menu map datalist annotation annotation-xml".split()
)
#: Elements that are left out if they hold little prose.
PARTS = frozenset(["form", "noscript"])
#: Paragraph points from which a container counts by itself.
LEAST = 10.0
#: Elements that belong to the text around them; every other element ends a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter "
    "nobr output picture progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math semantics annotation annotation-xml maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow "
    "ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none".split()
)
PARAGRAPHS = frozenset("p pre blockquote td th li dt dd h1 h2 h3 h4 h5 h6 figcaption caption summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag of the first group ends an open element of the second, up to the third.
_ENDS_P = frozenset(
    "p div article section ul ol dl table pre blockquote h1 h2 h3 h4 h5 h6 header footer nav aside main form hr "
    "address fieldset figure details".split()
)
_LIST, _TABLE = frozenset("ul ol menu".split()), frozenset(["table"])
CLOSES = {
    "li": (frozenset(["li"]), _LIST), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])), "tr": (frozenset(["tr", "td", "th"]), _TABLE),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
}
_SCOPE = frozenset("body article section main div td th li blockquote table".split())

#: Words in class, id or role that mark what is never part of an article.
NEVER = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion comment comments commentlist "
    "disqus replies reply respond cookie cookies consent gdpr notice notices notification alert breadcrumb breadcrumbs nav navbar "
    "navigation menu sidebar footer banner newsletter subscribe subscription popup modal overlay share sharing social pagination "
    "pager login signup toolbar masthead complementary contentinfo search dialog skip related recommended recommendations "
    "trending widget copyright disclaimer paywall".split()
)
#: Words of reader comments, which may be most of a page.
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
#: Words that may stand beside those in one name without changing what it says.
NEUTRAL = frozenset(
    "a an the and of for in to at on item items list lists box boxes block blocks wrap wrapper container inner outer area section bar bars "
    "panel group holder row col column left right top bottom side center middle main site page global local post posts article articles "
    "entry entries story stories content text body link links message text banner footer header user reader blog news home web www my our id js "
    "module modules component template layout region view large small big mini first last primary secondary third level sub form field feed "
    "google policy policies bottom sticky fixed mobile desktop thread count button buttons icon icons social media zone slot unit".split()
)
#: Names that tell what a page has, not what the element is.
_LAYOUT = re.compile(r"(?:no|has|with|without)[-_]", re.I)
_PLAIN = NEVER | NEUTRAL
#: Words of parts that are seldom the article; they weigh, and no such part is kept as a sibling.
SELDOM = frozenset("header head top bottom side meta tools tags author byline popular hidden aux extra rail teaser".split())
LIKELY = frozenset("article content main body post entry story text blog column page hentry".split())
#: Names of containers whose own header belongs to the article.
_ARTICLES = frozenset("article post entry story hentry".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_TAG_WEIGHT = {"article": 25, "main": 20, "div": 5, "section": 5, "pre": 3, "td": 3, "blockquote": 3} | dict.fromkeys(
    "address ol ul dl dd dt li form noscript".split(), -3) | dict.fromkeys(HEADINGS | {"th"}, -5)
_LEVELS = 6


class _Page(HTMLParser):
    """Elements (tag, parent, weight, dropped) and text blocks (element, text, link characters)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.weights, self.dropped = ["#root"], [0], [0], [False]
        self.stack = [0]
        self.open: dict[str, int] = {}
        self.blocks: list[tuple[int, str, int]] = []
        self.pieces: list[str] = []
        self.owner = self.links = 0
        self.doubtful: set[int] = set()
        self.named: set[int] = set()
        self.comments: set[int] = set()
        self.seldom: set[int] = set()
        self.articles: list[int] = []
        self.fields: set[int] = set()

    def _flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.blocks.append((self.owner, text, min(self.links, len(text))))
            self.pieces, self.links = [], 0

    def _pop(self) -> None:
        number = self.stack.pop()
        if self.articles and self.articles[-1] == number:
            self.articles.pop()
        tag = self.tags[number]
        self.open[tag] -= 1
        if tag not in INLINE:
            self._flush()

    def _close(self, targets: frozenset, barriers: frozenset) -> None:
        """End the innermost of ``targets`` unless a barrier lies inside it."""
        if not any(self.open.get(t) for t in targets):
            return
        for at in range(len(self.stack) - 1, 0, -1):
            tag = self.tags[self.stack[at]]
            if tag in targets:
                while len(self.stack) > at:
                    self._pop()
                return
            if tag in barriers:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.pieces.append(" ")
            return
        if tag in _ENDS_P:
            self._close(frozenset(["p"]), _SCOPE)
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag not in INLINE:
            self._flush()
        if tag in ("input", "select", "textarea", "button") and self.open.get("form") and ("type", "hidden") not in attrs:
            self.fields.add(next(i for i in reversed(self.stack) if self.tags[i] == "form"))
        if tag in VOID:
            return
        parent = self.stack[-1]
        weight, drop = self._judge(tag, attrs)
        self.tags.append(tag)
        self.parents.append(parent)
        self.weights.append(weight)
        self.dropped.append(drop or self.dropped[parent])
        if tag in PARTS:
            self.doubtful.add(len(self.tags) - 1)
        self.stack.append(len(self.tags) - 1)
        self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash does not close an HTML element

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and not self.open.get("p"):
            self._flush()
        if self.open.get(tag):
            while True:
                last = self.tags[self.stack[-1]]
                self._pop()
                if last == tag:
                    return

    def handle_data(self, data: str) -> None:
        at = self.stack[-1]
        if self.dropped[at]:
            return
        if not self.pieces:
            while self.tags[at] in INLINE:
                at = self.parents[at]
            self.owner = at
        self.pieces.append(data)
        if self.open.get("a"):
            self.links += len(" ".join(data.split()))

    def _judge(self, tag: str, attrs: list) -> tuple[int, bool]:
        weight, number = _TAG_WEIGHT.get(tag, 0), len(self.tags)
        inside = self.open.get("article") or self.open.get("main") or self.articles
        if tag in SKIPPED or (tag == "header" and not inside):
            return weight, True
        names: set[str] = set()
        never: set[str] = set()
        beside = False
        for name, value in attrs:
            if name in ("class", "id", "role"):
                for token in (value or "").split():
                    words = {w.lower() for w in _NAME.findall(token)}
                    if _LAYOUT.match(token):
                        words -= NEVER
                    found = words & NEVER
                    names |= words - NEVER
                    if found and words <= _PLAIN:
                        never |= found
                    else:
                        beside |= bool(words & LIKELY)
            elif tag not in ("html", "body") and (
                name == "hidden" or (name == "aria-hidden" and value == "true")
                or (name == "style" and value and _INVISIBLE.search(value))
            ):
                return weight, True
        if tag in ("html", "body") or tag in INLINE or tag in HEADINGS or not names | never:
            return weight, False
        if never & COMMENTS and not beside:
            self.comments.add(number)
        elif never and not beside and tag not in ("article", "main"):
            self.named.add(number)
        likely = beside or (bool(names & LIKELY) and not never)
        if names & SELDOM and not likely:
            self.seldom.add(number)
            weight -= 10
        if likely and names & _ARTICLES and not never:
            self.articles.append(number)
        return weight - 25 * bool(never) + 25 * likely, False

    def finish(self, html: str) -> None:
        self.feed(html)
        if self.rawdata.startswith("<!--"):
            self.rawdata = ""  # a comment that is never closed
        self.close()
        while len(self.stack) > 1:
            self._pop()
        self._flush()
        if self.comments:
            self._settle_comments()
        self.doubtful |= self.named
        if self.doubtful:
            self._settle()

    def _sums(self) -> tuple[list[float], list[bool]]:
        """Points of each element with all in it, and whether an article with prose is in it."""
        points, articles = [0.0] * len(self.tags), [False] * len(self.tags)
        for owner, text, _ in self.blocks:
            if self.tags[owner] not in HEADINGS:
                points[owner] += _points(text)
        for i in range(len(self.tags) - 1, 0, -1):
            parent = self.parents[i]
            points[parent] += points[i]
            articles[parent] |= articles[i] or (self.tags[i] in ("article", "main") and points[i] > 0)
        return points, articles

    def _drop(self, chosen) -> None:
        for i in range(1, len(self.tags)):
            if self.dropped[self.parents[i]] or chosen(i):
                self.dropped[i] = True
        self.blocks = [b for b in self.blocks if not self.dropped[b[0]]]

    def _settle_comments(self) -> None:
        """Drop the readers' comments, unless nothing else is on the page."""
        points, _ = self._sums()
        inside = [False] * len(self.tags)
        for i in range(1, len(self.tags)):
            inside[i] = i in self.comments or inside[self.parents[i]]
        told = sum(points[i] for i in self.comments if not inside[self.parents[i]])
        if points[0] - told > 0:
            self._drop(self.comments.__contains__)

    def _settle(self) -> None:
        """Drop the doubtful elements with little prose."""
        points, articles = self._sums()
        self._drop(lambda i: i in self.doubtful and not self._holds_prose(i, points, articles))

    def _holds_prose(self, i: int, points: list[float], articles: list[bool]) -> bool:
        if points[i] > 0.5 * points[0]:
            return True
        if self.tags[i] in PARTS and (articles[i] or points[i] >= LEAST) and i not in self.named:
            return True
        return self.tags[i] == "form" and i not in self.fields and i not in self.named


def _points(text: str) -> float:
    return (len(text) >= 25) + text.count(",") + text.count("、") + text.count("，") + min(len(text) / 100, 3)


def _keepers(page: _Page) -> tuple[set[int], int]:
    """The best container and the siblings that are kept with it, and the best by itself."""
    count = len(page.tags)
    score, chars, links = [0.0] * count, [0] * count, [0] * count
    own: dict[int, list[str]] = {}
    touched = set()
    for owner, text, linked in page.blocks:
        own.setdefault(owner, []).append(text)
        chars[owner] += len(text)
        links[owner] += linked
        points = _points(text)
        if page.tags[owner] in HEADINGS:
            continue
        at = page.parents[owner] if page.tags[owner] in PARAGRAPHS else owner
        for level in range(_LEVELS):
            score[at] += points / (1, 2, 3, 6, 9, 12)[level]
            touched.add(at)
            if at == 0:
                break
            at = page.parents[at]
    for i in range(count - 1, 0, -1):
        chars[page.parents[i]] += chars[i]
        links[page.parents[i]] += links[i]

    def final(i: int) -> float:
        return (score[i] + page.weights[i]) * (1 - links[i] / chars[i]) if chars[i] else 0.0

    ranked = [i for i in touched if page.tags[i] not in ("html", "#root")]
    if not ranked:
        return {0}, 0
    best = max(ranked, key=lambda i: (final(i), -i))
    above = best
    while above:  # parts of one article belong together
        if page.tags[above] == "article" and final(above) > 0:
            best = above
        above = page.parents[above]
    if best == 0 or page.tags[best] == "body":
        return {best}, best
    least = max(LEAST, final(best) / 5)
    kept, parent = {best}, page.parents[best]
    beside = [i for i in range(1, count) if page.parents[i] == parent and not page.dropped[i] and chars[i]]
    titles = _only_headings(page)
    for i in beside:
        if i == best or i in page.seldom:
            continue
        density = links[i] / chars[i]
        if i in touched and final(i) - page.weights[i] * (1 - density) >= least:
            kept.add(i)
        elif page.tags[i] == "p" and i in own:
            text = " ".join(own[i])
            if (len(text) > 80 and density < 0.25) or (density == 0 and re.search(r"[.!?。]( |$)", text)):
                kept.add(i)
        elif i in titles and density == 0 and i < best:
            kept.add(i)
    first, last = min(kept), max(kept)
    kept |= {i for i in beside if first < i < last and links[i] <= 0.25 * chars[i] and i not in page.seldom}
    return kept, best


def _only_headings(page: _Page) -> set[int]:
    """Elements all of whose text is in headings."""
    other, some = [False] * len(page.tags), [False] * len(page.tags)
    for owner, _, _ in page.blocks:
        heading = page.tags[owner] in HEADINGS
        some[owner] |= heading
        other[owner] |= not heading
    for i in range(len(page.tags) - 1, 0, -1):
        some[page.parents[i]] |= some[i]
        other[page.parents[i]] |= other[i]
    return {i for i in range(1, len(page.tags)) if some[i] and not other[i]}


def _link_lists(page: _Page) -> set[int]:
    """Lists and tables that are mostly links."""
    chars, links = [0] * len(page.tags), [0] * len(page.tags)
    for owner, text, linked in page.blocks:
        chars[owner] += len(text)
        links[owner] += linked
    for i in range(len(page.tags) - 1, 0, -1):
        chars[page.parents[i]] += chars[i]
        links[page.parents[i]] += links[i]
    return {i for i, t in enumerate(page.tags) if t in ("ul", "ol", "dl", "table") and links[i] > 0.5 * chars[i]}


def main_text(html: str | None) -> str:
    """The article's text of one page."""
    if not html:
        return ""
    page = _Page()
    page.finish(html)
    if not page.blocks:
        return ""
    lists = _link_lists(page)
    roots, best = _keepers(page)
    whole = page.tags[best] in ("#root", "body")
    inside, within = [0 in roots], [False]
    for i in range(1, len(page.tags)):
        within.append((i == best and not whole) or within[page.parents[i]])
        inside.append((within[i] or i not in lists) and (i in roots or inside[page.parents[i]]))
    return "\n\n".join(text for owner, text, _ in page.blocks if inside[owner])


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``; a projection, nothing is shuffled."""
    kept = [f for f in pages.schema.fields if f.name.lower() not in ("text", "n_chars")]
    names = [f.name for f in kept]
    source = pages[html].cast("string").alias("_html")
    schema = StructType(list(kept)).add("text", StringType()).add("n_chars", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h) for h in part.column(part.num_columns - 1).to_pylist()]
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[*names, "text", "n_chars"],
                )

    return pages.select(*names, source).mapInArrow(run, schema)
