"""HTML extraction (9): paragraphs score their ancestors, the best container is kept.

A page is read once into blocks of text, each in its innermost element.  Blocks
pass points for length and commas to LEVELS ancestors, less at each level and
discounted by link density.  The element of most points is the container; it
grows to the article or main element around it, and siblings that read like the
same story join it.  All text in these is kept but for boilerplate: elements
that are so by tag, role or hiding (menus, headers, footers, sidebars, adverts,
forms, scripts, styles), and elements whose class or id names boilerplate, if
place and content agree (see `_named` and `_dropped`).

Defined results: a null or empty page, or one without text, gives an empty
text; broken or cut markup is read as far as it goes; a page whose text has no
container of its own gives the text of its body; repeated rows are extracted
alike and other columns stay; an empty table gives an empty one.  Time is linear
in the page, however deep its elements are.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements by role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
DROPPED = frozenset("head title nav footer aside form button select option svg canvas dialog menu script style noscript template textarea iframe object audio video map".split())
CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIST_ENDS = frozenset("ul ol dl table".split())
#: Names of boilerplate wherever it stands.
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners promo promos promotion sponsor sponsored sponsors"
    " sidebar sidebars comment comments commentlist respond replies disqus cookie cookies consent gdpr newsletter subscribe subscription"
    " share sharing breadcrumb breadcrumbs menu menus nav navbar navigation footer masthead popup modal"
    " login signup pagination pager paywall outbrain taboola".split()
)
#: Names that parts of an article have too.
WEAK_NAMES = frozenset(
    "side discussion reply notice notices alert warning social related recommended recommendations overlay header widget widgets toolbar"
    " legal copyright disclaimer skip search form tags teaser".split()
)
#: Parts of a name that say nothing of their own.
FILLERS = frozenset(
    "area bar block body box bottom center col column container content entry first global group inner item items js last left link links list main"
    " mobile module outer page panel post primary right row secondary section site slot text top unit user wrap wrapper zone".split()
)
NEUTRAL_NAMES = frozenset("with has no without".split())
#: Elements that are never dropped by name.
CONTENT = frozenset("html body article main h1 h2 h3 h4 h5 h6 pre blockquote table thead tbody tr td th figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar status alertdialog".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<[a-zA-Z/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_SENTENCE_ENDS = frozenset(".!?…:;。！？\"'”’»)")
_PARAGRAPHS = frozenset("p pre td blockquote li dd div section article".split())


#: Ancestors that a paragraph scores.
LEVELS = 5


def _gone(tag: str, attributes: str, inside_article: bool) -> bool:
    """Boilerplate by tag, role or hiding."""
    if tag in DROPPED:
        return True
    if tag == "header":
        return not inside_article
    if not attributes or tag in ("html", "body"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in BAD_ROLES):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _named(tag: str, attributes: str) -> int:
    """2 if class or id names boilerplate, 1 if by a weak name only.

    A name counts if all its parts are names of boilerplate, numbers or fillers: `related-box`, not `related-work`.
    """
    if not attributes or tag in INLINE or tag in CONTENT:
        return 0
    found = 0
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id"):
            for word in (m[2] or m[3] or m[4] or "").lower().split():
                parts = [p for p in re.split(r"[-_]+", word) if p and not p.isdigit()]
                if not NEUTRAL_NAMES.isdisjoint(parts) or not all(p in BAD_NAMES or p in WEAK_NAMES or p in FILLERS for p in parts):
                    continue
                found = max(found, 2 if not BAD_NAMES.isdisjoint(parts) else 1 if not WEAK_NAMES.isdisjoint(parts) else 0)
    return found


class Page:
    """Text blocks (text, element, linked characters) and, for each block element, its tag, parent, class, name's strength, and whether it is in an article."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, int, int]] = []
        self.tags, self.parents, self.classes, self.named, self.in_article = ["#root"], [-1], [""], [0], [False]
        self._read(html)

    def _read(self, html: str) -> None:
        # open elements: tag, own block element or -1, whether dropped, innermost block element
        stack: list[tuple[str, int, bool, int]] = [("#root", 0, False, 0)]
        opened: dict[str, int] = defaultdict(int)
        parts: list[str] = []
        linked = 0

        def flush() -> None:
            nonlocal linked
            if parts:
                text = " ".join(unescape("".join(parts)).split())
                if text:
                    self.blocks.append((text, stack[-1][3], min(linked, len(text))))
                parts.clear()
            linked = 0

        def close(depth: int) -> None:
            if any(e >= 0 for _, e, _, _ in stack[depth:]):
                flush()
            for tag, _, _, _ in stack[depth:]:
                opened[tag] -= 1
            del stack[depth:]

        at, end = 0, len(html)
        while at < end:
            m = _MARKUP.search(html, at)
            upto = m.start() if m else end
            if upto > at and not stack[-1][2]:
                parts.append(html[at:upto])
                linked += (upto - at) if opened["a"] else 0
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if opened[tag]:
                    close(next(depth for depth in range(len(stack) - 1, 0, -1) if stack[depth][0] == tag))
                elif tag not in INLINE:
                    flush()
                continue
            if tag == "br":
                if not stack[-1][2]:
                    parts.append(" ")
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                continue
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(html, at)
                at = stop.end() if stop else end
                continue
            ends = SAME_CLOSES.get(tag, {"p"} if tag in CLOSES_P else set()) | ({"p"} if tag in CLOSES_P else set())
            if any(opened[e] for e in ends):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] in ends:
                        close(depth)
                        break
                    if stack[depth][1] >= 0 and (tag in CLOSES_P or stack[depth][0] in LIST_ENDS):
                        break
            in_article = opened["article"] + opened["main"] > 0
            dropped = stack[-1][2] or _gone(tag, m[3], in_article)
            if tag in INLINE:
                stack.append((tag, -1, dropped, stack[-1][3]))
            else:
                flush()
                self.parents.append(stack[-1][3])
                self.tags.append(tag)
                self.named.append(0 if dropped else _named(tag, m[3]))
                self.classes.append(" ".join(w for a in _ATTRIBUTE.finditer(m[3]) if a[1].lower() == "class" for w in (a[2] or a[3] or a[4] or "").split()))
                self.in_article.append(in_article)
                stack.append((tag, len(self.tags) - 1, dropped, len(self.tags) - 1))
            opened[tag] += 1
            if m[3].endswith("/") and tag not in INLINE and tag not in CLOSES_P:
                close(len(stack) - 1)
        flush()

    def summed(self, values: dict[int, float]) -> list[float]:
        """For each element, its own value and those of all elements in it; parents stand before their children."""
        total = [values.get(e, 0) for e in range(len(self.tags))]
        for e in range(len(total) - 1, 0, -1):
            total[self.parents[e]] += total[e]
        return total

    def within(self, chosen: set[int]) -> list[bool]:
        """For each element, whether it or an ancestor is chosen."""
        out = [0 in chosen]
        for e in range(1, len(self.tags)):
            out.append(e in chosen or out[self.parents[e]])
        return out


def _sums(page: Page) -> tuple[list[float], list[float]]:
    length, linked = defaultdict(int), defaultdict(int)
    for text, e, n in page.blocks:
        length[e] += len(text)
        linked[e] += n
    return page.summed(length), page.summed(linked)


def _dropped(page: Page) -> set[int]:
    """Elements that their name and their place or content make boilerplate.

    One that holds an article or main element never is, nor, by a weak name, one with a
    long text that is more than half of the page's.  A weak name needs more in an
    article: many links, or a short text that has no heading.
    """
    length, linked = _sums(page)
    headings = page.summed({e: 1 for e, tag in enumerate(page.tags) if tag in HEADINGS})
    articles = page.summed({e: 1 for e, tag in enumerate(page.tags) if tag in ("article", "main")})
    out = set()
    for e, strength in enumerate(page.named):
        if not strength or articles[e]:
            continue
        many_links, slight = linked[e] > 0.3 * length[e], length[e] < 400 and not headings[e]
        most = length[e] >= 400 and 2 * length[e] > length[0]
        if strength == 2 or many_links or slight or not (page.in_article[e] or most):
            out.add(e)
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Page(html)
    gone = page.within(_dropped(page))
    page.blocks = [b for b in page.blocks if not gone[b[1]]]
    if not page.blocks:
        return ""
    tags, parents = page.tags, page.parents
    points: dict[int, float] = defaultdict(float)
    for text, own, of_links in page.blocks:
        n = len(text)
        if n < 25 or tags[own] not in _PARAGRAPHS:
            continue
        worth = (1 + text.count(",") + text.count("，") + min(n / 100, 3)) * (1 - of_links / n)
        e = own if tags[own] in ("div", "section", "article") else parents[own]
        for level in range(LEVELS):
            if e < 0:
                break
            points[e] += worth / (1 if level == 0 else 2 if level == 1 else 3 * level)
            e = parents[e]
    length, linked = _sums(page)
    density = [linked[e] / max(length[e], 1) for e in range(len(tags))]
    scored = {e: s * (1 - density[e]) for e, s in points.items() if tags[e] not in ("#root", "html", "body")}
    if not scored:
        return "\n".join(text for text, _, _ in page.blocks)
    best = max(scored, key=lambda e: (scored[e], -e))
    top = scored[best]
    e = best
    while e > 0:  # the article around it, the outermost; else main
        if tags[e] == "article" or (tags[e] == "main" and tags[best] != "article"):
            best = e
        e = parents[e]
    kept = {best}
    if tags[best] != "main":
        ends = page.summed({e: 1 for e in {own for text, own, _ in page.blocks if text[-1] in _SENTENCE_ENDS}})
        headings = page.summed({e: 1 for e, tag in enumerate(tags) if tag in HEADINGS})
        paragraphs = page.summed({own: 1 for text, own, _ in page.blocks if len(text) >= 25})
        for e, parent in enumerate(parents):
            if parent != parents[best] or e == best or not length[e] or density[e] >= 0.25:
                continue
            if tags[best] == "article":  # further articles beside it
                story = tags[e] == "article" and paragraphs[e]
            elif tags[e] in ("div", "section"):  # parts of the story; those of the page itself have to look alike
                alike = tags[parent] not in ("#root", "html", "body") or (tags[e] == tags[best] and page.classes[e] == page.classes[best])
                story = scored.get(e, 0) >= max(10, 0.2 * top) or (alike and (ends[e] or headings[e]))
            else:
                story = tags[e] in ("p", "h1", "h2", "h3", "pre", "blockquote") or (tags[e] in ("ul", "ol", "table") and length[e] >= 80)
            if story:
                kept.add(e)
    inside = page.within(kept)
    return "\n".join(text for text, own, _ in page.blocks if inside[own])


def extract(pages: DataFrame) -> DataFrame:
    """pages with `text` and `n_chars` in place of columns of these names; no shuffle."""
    rest = [c for c in pages.columns if c not in ("text", "n_chars")]
    at = rest.index("html")
    frame = pages.select(*(f"`{c}`" for c in rest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = [main_text(h.as_py()) for h in part.column(at)]
                columns = [c for k, c in enumerate(part.columns) if k != at]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*(n for n in rest if n != "html"), "text", "n_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields if f.name != "html")
    return frame.mapInArrow(run, f"{schema}, text string, n_chars bigint" if schema else "text string, n_chars bigint")
