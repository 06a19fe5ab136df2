"""Main text of web pages by two-pass block rules.

The first pass cuts a page into blocks and decides those it can: blocks in
menus, adverts and the like, outside the article that holds the page's dense
text, or made of links are boilerplate; long blocks with enough stop words
(dense ones) are text.  A menu, advert or the like that holds the page's
article or most of its dense text is a mere wrapper and doesn't count.  The
second pass gives ambiguous blocks, short ones above all, the label of the
nearest decided neighbour of the same region (of two as near, the text); a
long one is text if the decided neighbour on either side is.

A null or empty page gives an empty text.  Broken markup is read as far as
it goes; a page cut off in mid-element keeps its text.  Rows that repeat
are extracted one by one.  An empty table gives an empty result.  Extra
columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

LONG = 70  # characters from which a block is judged by its stop words
STOP_SHARE = 0.15  # of the words of a long block of text
LINK_SHARE = 0.5  # of the characters of a block of links

#: Frequent function words of four languages; fixed values.
STOP_WORDS = frozenset("""
a an and are as at be but by for from had has have he in is it its not of on or that the they this to was were which with
aber als am an auch auf aus bei das dem den der des die ein eine er es für haben hat ich im in ist mit nicht oder sich sie sind und von war wie wird zu
à au aux avec ce ces dans de des du elle en est et il la le les leur ne nous ou par pas plus pour que qui sa se ses son sont sur un une
al como con de del el ella en entre es esta este ha la las lo los más no o para pero por que se sin sobre su sus un una y
""".split())

SKIPPED = frozenset("head noscript template svg math iframe object canvas select textarea button datalist audio video map dialog".split())
BOILERPLATE = frozenset("nav footer aside form fieldset menu".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Parts of class, id and role values that mark boilerplate.
MARKS = frozenset("""ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright disqus footer
legal login menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup
social sponsor sponsored subscribe subscription toolbar widget widgets""".split())
#: Of these, the ones that name a thing beside the text, however much of the page it is; and such elements.
BESIDE = frozenset("ad ads advert advertisement advertising adverts comment comments consent cookie cookies disqus modal newsletter popup recommended related replies reply respond sponsor sponsored".split())
BESIDE_TAGS = BOILERPLATE - {"form"}
#: Parts of a class word that turn a mark into a statement on layout, and parts behind a mark that only say what kind of box it is.
LAYOUT = frozenset("closed disable disabled enabled free has hide hides is no non not open show shows status with without".split())
STARTS = frozenset("ad ads advert comment cookie modal newsletter popup".split())  # marks at a word's start, whatever follows
BOXES = frozenset("""area articles bar block body bottom box button buttons card cards col column container content entry form group header heading holder icon icons inline inner item items left link links list
main module outer overlay panel placeholder post posts region right row section slot stories story tab tabs title toggle top unit wrap wrapper""".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|title|xmp)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)
    |<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-z][^>]*+(?:>|\Z)|<[!?][^>]*+(?:>|\Z)""", re.I | re.S | re.X)
ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PARTS = re.compile(r"[a-z]+")
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    inside: "Wrapper | None"  # the innermost boilerplate element around it
    article: int  # number of the outermost article or main element around it, 0: none
    label: bool | None = field(default=None)

    @property
    def bad(self) -> bool:
        return self.inside is not None and self.inside.shut

    @property
    def linked(self) -> bool:
        return self.links > LINK_SHARE * len(self.text)


@dataclass(eq=False)
class Wrapper:
    """A boilerplate element, by its tag or marks."""

    beside: bool  # names a thing beside the text
    parent: "Wrapper | None"  # the boilerplate element around it
    depth: int  # of such elements
    article: bool = False  # is, or holds, an article or main element
    released: bool = False  # found to be a mere wrapper
    shut: bool = True  # it, or one around it, isn't released
    weight: int = 0  # of the blocks in it, and how many have any
    weighty: int = 0


def mark_of(word: str) -> set[str]:
    """The parts of a class word if the word, or its last part but for names of boxes, is a mark."""
    parts = PARTS.findall(word)
    if MARKS.isdisjoint(parts) or not LAYOUT.isdisjoint(parts):
        return set()
    last = len(parts) - 1
    while last and (parts[last] in BOXES or len(parts[last]) == 1):
        last -= 1
    return set(parts) if parts[last] in MARKS or parts[0] in STARTS else set()


def marked(tag: str, attrs: str) -> tuple[set[str], bool]:
    """(parts of the words that mark boilerplate, hidden) by an element's attributes."""
    marks, hidden = set(), False
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
        elif name in ("class", "id", "role") and tag not in ("html", "body", "main"):
            for word in value.split():
                marks |= mark_of(word)
    return marks, hidden


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order, with where they stand."""
    out: list[Block] = []
    stack: list[tuple[str, Wrapper | None, bool, int]] = []  # (tag, boilerplate, skipped, article), each with what is above it
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    links, depth_a, at, articles = 0, 0, 0, 0

    def state() -> tuple[Wrapper | None, bool, int]:
        return stack[-1][1:] if stack else (None, False, 0)

    def pop() -> str:
        tag = stack.pop()[0]
        open_tags[tag] -= 1
        return tag

    def close() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                inside, _, article = state()
                out.append(Block(text, links, inside, article))
            parts.clear()
        links = 0

    def add(text: str) -> None:
        nonlocal links
        if text and not state()[1]:
            parts.append(text)
            if depth_a:
                links += len(" ".join(html.unescape(text).split()))

    for m in TOKEN.finditer(page):
        add(page[at:m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "a":
            depth_a = 0 if m["end"] else 1
        if m["end"]:
            if tag in BLOCKS:
                close()
            if open_tags[tag]:
                while pop() != tag:
                    pass
            continue
        if tag in BLOCKS:
            close()
            shut = CLOSES.get(tag, {"p"})
            while stack and stack[-1][0] in shut:
                pop()
        elif tag == "br":
            parts.append(" ")
        if tag in VOID:  # no other element closes itself
            continue
        inside, skipped, article = state()
        marks, hidden = marked(tag, m["attrs"]) if m["attrs"].strip() else (set(), False)
        if tag in BLOCKS or tag in SKIPPED or marks or hidden:
            if marks and tag not in BLOCKS:
                close()
            if marks or tag in BOILERPLATE or tag == "header" and not article:
                inside = Wrapper(not BESIDE.isdisjoint(marks) or tag in BESIDE_TAGS, inside, inside.depth + 1 if inside else 0)
            if tag in ("article", "main"):
                w = inside
                while w and not w.article:
                    w.article, w = True, w.parent
                if not article:
                    articles += 1
                    article = articles
            stack.append((tag, inside, skipped or hidden or tag in SKIPPED, article))
            open_tags[tag] += 1
    add(page[at:])
    close()
    return out


def dense(b: Block) -> bool:
    """Whether a block is long and has the stop words of running text."""
    if len(b.text) < LONG or b.linked:
        return False
    words = [w.lower() for w in WORD.findall(b.text)]
    return bool(words) and sum(w in STOP_WORDS for w in words) >= STOP_SHARE * len(words)


def wrappers_of(blocks: list[Block]) -> list[Wrapper]:
    """Every boilerplate element around a block, outer ones first."""
    found: dict[Wrapper, None] = {}
    for b in blocks:
        w = b.inside
        while w is not None and w not in found:
            found[w], w = None, w.parent
    return sorted(found, key=lambda w: w.depth)


def settle(wrappers: list[Wrapper]) -> None:
    for w in wrappers:
        w.shut = not w.released or w.parent is not None and w.parent.shut


def release(blocks: list[Block], weight: list[int], long: bool) -> None:
    """Mark the boilerplate elements that are mere wrappers.  ``weight``: characters of dense text of each block; ``long``: of long blocks at least."""
    wrappers = wrappers_of(blocks)
    for b, w in zip(blocks, weight):
        if w and b.inside:
            b.inside.weight += w
            b.inside.weighty += 1
    for x in reversed(wrappers):
        if x.parent:
            x.parent.weight += x.weight
            x.parent.weighty += x.weighty
    held = [x for x in wrappers if x.weighty]
    total, free = sum(weight), sum(w for b, w in zip(blocks, weight) if not b.inside)
    alone = not any(not b.inside and not b.linked for b in blocks)
    for x in held:
        if not x.beside:
            most = long and 2 * x.weight > total and (x.weighty > 1 or alone)
            x.released = most or x.article and (x.weight > free or 2 * x.weight > total)
    settle(wrappers)
    if long and all(b.bad or b.linked for b in blocks):  # nothing is left
        for x in held:
            x.released |= 2 * x.weight > total and (x.weighty > 1 or x.article)
        settle(wrappers)


def decide(blocks: list[Block]) -> list[Block]:
    """Both passes: every block's ``label`` (True: text)."""
    is_dense = [dense(b) for b in blocks]
    # no language that the stop words cover: length and links decide, or links alone
    for long, counts in ((True, is_dense), (True, [len(b.text) >= LONG and not b.linked for b in blocks]), (False, [not b.linked for b in blocks])):
        weight = [len(b.text) * c for b, c in zip(blocks, counts)]
        if any(weight):
            break
    if any(b.inside for b in blocks):
        release(blocks, weight, long)
    bad = [b.bad for b in blocks]
    # the article is the region if it holds as much dense text as all that stands outside articles
    by_article: dict[int, int] = {}
    for b, w, x in zip(blocks, weight, bad):
        if not x:
            by_article[b.article] = by_article.get(b.article, 0) + w
    beyond = by_article.pop(0, 0)
    region = bool(by_article) and (not long or max(by_article.values()) >= beyond)
    doubtful = []
    for b, d, x in zip(blocks, is_dense, bad):
        if x or region and not b.article or b.linked:
            b.label = False
        elif d:
            b.label = True
        elif len(b.text) >= LONG:
            doubtful.append(b)
    if not any(b.label for b in blocks):
        for b in doubtful:
            b.label = True
    some = any(b.label for b in blocks)
    places: dict[int, list[int]] = {}  # without a region, an article beside the text follows its own blocks only
    for i, (b, x) in enumerate(zip(blocks, bad)):
        if not region or b.article and not x:
            places.setdefault(0 if region else b.article, []).append(i)
    for place, members in places.items():
        later, before = iter([i for i in members if blocks[i].label is not None]), None
        nxt = next(later, None)
        for i in members:
            b = blocks[i]
            while nxt is not None and nxt <= i:
                before, nxt = nxt, next(later, None)
            if b.label is None:
                near = [(abs(k - i), not blocks[k].label) for k in (before, nxt) if k is not None and k != i]
                if len(b.text) >= LONG and near:
                    b.label = not all(x for _, x in near)
                else:
                    b.label = not min(near)[1] if near else not place or not some
    return blocks


def main_text(page: str | None) -> str:
    return "\n\n".join(b.text for b in decide(blocks_of(page)) if b.label) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def task(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(task, f"page_id {kind}, url string, text string, n_chars long")
