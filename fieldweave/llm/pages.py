"""Main text of web pages by two passes of block rules.

Markup becomes blocks of text. In the first pass, link density, length and stop-word density decide
each block. What its place tells is one more feature: inside a marked article the same densities are asked for at
lower limits, elements of menus, headers, footers, sidebars and forms and names of
adverts, consents and reader comments are never text, other names of the frame are overruled by long
unlinked text, and where a page marks its article, nothing outside is. In the second pass, blocks that the first left
open take the label of the nearest decided neighbours. Good blocks are joined in page order.

Scale: a map over pages without a shuffle; a page is handled alone. Markup is scanned in linear time, however
many tags, quotes or elements are left open, so that one broken page can't hold up a task.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import fresh

#: Elements whose content is never text of the page; they end at their own end tag.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "select", "canvas", "audio", "video", "noembed", "noframes", "xmp")
#: Those that hold all up to the page's end if they have no end tag; of the others, only the tag goes then.
TO_END = {"script", "style", "textarea", "title", "template", "iframe", "noembed", "noframes", "xmp"}
#: Elements of the page's frame.
FRAME = {"nav", "aside", "footer", "header", "form", "menu", "dialog", "button", "fieldset", "head"}
#: Elements that can hold blocks; what they say of a block holds until they end.
HOLDERS = FRAME | {"html", "body", "main", "article", "section", "div", "ul", "ol", "dl", "table", "figure", "details", "center"}
#: Elements that begin and end a block.
BREAKS = HOLDERS | {"p", "li", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "blockquote", "pre", "hr", "address", "figcaption", "summary", "legend", "option", "optgroup", "hgroup"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words of class and id names that mark the page's frame.
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "sidebar",
    "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "topbar", "comment", "comments", "commentlist", "respond",
    "disqus", "replies", "reply", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription",
    "signup", "login", "share", "sharing", "social", "related", "recommended", "widget", "widgets", "pagination", "pager", "toolbar", "copyright", "skip", "search",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "note"}
REMARKS = {"comment", "comments", "commentlist", "reply", "replies", "disqus", "respond"}
#: Words that tell of no text of the article whatever it reads like, where a name has no other words.
FIRM = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay"}
#: Words after which a name tells of the page's layout ("has-sidebar"), and words for the article itself ("entry-header").
LAYOUT = {"has", "with", "no", "without"}
OWN = {"article", "post", "entry", "story", "content", "page", "main"}
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his i if in into is it its not of on or our she so that the their them then there these they this to was we were what when which who will with you "
    "aber als am auch auf aus bei bis das dass dem den der des die du ein eine einem einen einer er es für hat ich ihr im ist mit nach nicht noch nur oder sein sich sie sind so über um und uns vom von vor war was wenn wie wir wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais me ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur tu un une vous y "
    "al como con del el ella ellos era es esta este está fue ha hay las lo los mi más muy no o para pero por se sin sobre su sus también te una uno ya".split()
)
#: Limits of the first pass: links, short and long texts, and stop words; the last four also inside a marked article.
MAX_LINKS = 0.4
SHORT, LONG, STOP_LOW, STOP_HIGH = 70, 200, 0.15, 0.30
MARKED_SHORT, MARKED_LONG, MARKED_LOW, MARKED_HIGH = 30, 70, 0.05, 0.20
#: Most links in a block whose text overrules a name.
NAMED_LINKS = 0.1

_NAME = re.compile(r"""\b(class|id|role|style|aria-hidden)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_TAG_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: Most tags: no '<' before their end, so a try that fails reads no farther than the next one begins.
_PLAIN_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*+)((?:[^"'<>]+|"[^"<>]*"|'[^'<>]*')*+)>""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in TO_END}
_OPEN_VALUE = re.compile(r"""=\s*[^\s"'>]*/$""")
_CUT_TAG = re.compile(r"<[a-zA-Z/!?]")
_STRIP = {ord(c): " " for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”„"}


@dataclass(slots=True)
class Block:
    text: str
    linked: int
    framed: bool
    article: int  # number of the article or main element around it; 0: none
    heading: bool
    label: str = ""
    named: bool = False  # a name says that it is of the frame, which its text can overrule
    inner: bool = False  # the article stands inside a holder of such a name


def _evidence(parts: list[str], inside: bool) -> int:
    """What one class or id name tells: 2 never text, 1 perhaps none, 0 nothing. ``inside`` an article, its own header is text."""
    layout = next((i for i, w in enumerate(parts) if w in LAYOUT), len(parts))
    words = set(parts[:layout])
    if inside and words & OWN:
        words -= {"header"}
    if words & REMARKS or (words & FIRM and words <= NAMES):
        return 2
    return int(bool(words & NAMES))


def _framed(name: str, attributes: str, inside: bool) -> int:
    """Whether an element's name or attributes say that it is no text of the article: 2 surely, 1 perhaps, 0 no."""
    found = dict((k.lower(), v.strip("\"'")) for k, v in _NAME.findall(attributes)) if attributes else {}
    if "hidden" in attributes.lower() and (re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes, re.I) or found.get("aria-hidden", "").lower() == "true"):
        return 2
    if "style" in found and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found["style"], re.I):
        return 2
    names = [[w.lower() for w in _PART.findall(n)] for k in ("class", "id") if k in found for n in found[k].split()]
    if name in ("html", "body", "main"):
        return 0
    if name == "article":
        return 2 * any(REMARKS & set(n) for n in names)
    if found.get("role", "").lower() in ROLES:
        return 2
    return max((_evidence(n, inside) for n in names), default=0)


def _self_closed(name: str, attributes: str) -> bool:
    """Whether a tag ends its element: only in svg and math, and where the '/' is no end of a value without quotes."""
    return name in ("svg", "math") and attributes.endswith("/") and not _OPEN_VALUE.search(attributes)


@dataclass(slots=True)
class Tag:
    start: int
    end: int
    close: bool
    name: str  # empty for comments, declarations and the like
    attributes: str


class _Scanner:
    """Tags of a page in order, in linear time.

    A tag ends at the first ``>`` outside of quotes. A '<' whose tag does not end is text. Positions of quotes
    and ends are listed once; where a tag was found not to end, every tag that comes to one of the places it passed
    outside of quotes does not end either, so no place is passed twice in vain.
    """

    def __init__(self, page: str):
        self.page = page
        self.marks: list[int] | None = None  # listed once a tag needs them
        self.last_end = page.rfind(">")
        self.dead: set[int] = set()

    def tag_end(self, at: int) -> int:
        """The place after the ``>`` that ends a tag whose name ends at ``at``; -1 if none does."""
        if at > self.last_end:
            return -1
        if self.marks is None:
            self.marks = [m.start() for m in re.finditer("[\"'>]", self.page)]
            self.quotes = {q: [i for i in self.marks if self.page[i] == q] for q in "\"'"}
        passed, i = [], bisect_left(self.marks, at)
        while i < len(self.marks) and i not in self.dead:
            spot = self.marks[i]
            if self.page[spot] == ">":
                return spot + 1
            passed.append(i)
            same = self.quotes[self.page[spot]]
            k = bisect_left(same, spot + 1)
            if k == len(same):
                break
            i = bisect_left(self.marks, same[k]) + 1
        self.dead.update(passed)
        return -1

    def _after(self, name: str, close: bool, end: int) -> int:
        """Where the next tag may begin: content of some elements is no markup."""
        if close or name not in TO_END:
            return end
        found = _RAW_END[name].search(self.page, end)
        return found.start() if found else len(self.page)

    def tags(self) -> Iterator[Tag]:
        page, at = self.page, 0
        while (at := page.find("<", at)) >= 0:
            if m := _PLAIN_TAG.match(page, at):
                close, name = bool(m[1]), m[2].lower()
                yield Tag(at, m.end(), close, name, m[3])
                at = self._after(name, close, m.end())
            elif page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                yield Tag(at, at := len(page) if end < 0 else end + 3, False, "", "")
            elif page.startswith("<![CDATA[", at):
                end = page.find("]]>", at)
                yield Tag(at, at := len(page) if end < 0 else end + 3, False, "", "")
            elif m := _TAG_NAME.match(page, at):
                if (end := self.tag_end(m.end())) < 0:
                    at += 1
                    continue
                name, close = m[1].lower(), page[at + 1] == "/"
                yield Tag(at, end, close, name, page[m.end() : end - 1])
                at = self._after(name, close, end)
            elif at + 1 < len(page) and page[at + 1] in "!?/" and at < self.last_end:
                yield Tag(at, at := page.find(">", at) + 1, False, "", "")
            else:
                at += 1


def _skipped(tags: list[Tag]) -> dict[int, int]:
    """For the opening tags of elements without text: the number of the tag that ends them.

    Those that hold all up to the page's end if nothing ends them end at the page's end; of the others, only the tag goes then.
    """
    out, begun = {}, {name: [] for name in RAW}
    for i, t in enumerate(tags):
        if t.name not in begun:
            continue
        if t.name in TO_END:
            if not t.close:
                out[i] = i + 1
        elif t.close:
            if begun[t.name]:
                out[begun[t.name].pop()] = i
        elif not _self_closed(t.name, t.attributes):
            begun[t.name].append(i)
    return out


def blocks(page: str) -> list[Block]:
    """A page's blocks of text in order. Markup may be cut off or wrongly nested."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, bool, bool]] = []  # element, framed, article, named, inner
    opened: Counter[str] = Counter()  # names on the stack
    text: list[tuple[str, bool]] = []
    articles = in_link = 0
    heading = False

    def flush() -> None:
        nonlocal text
        if text:
            whole = " ".join(html.unescape("".join(t for t, _ in text)).split())
            if whole:
                _, framed, article, by_name, inner = stack[-1] if stack else ("", False, 0, False, False)
                linked = sum(len(" ".join(html.unescape(t).split())) for t, link in text if link)
                out.append(Block(whole, linked, framed, article, heading, named=by_name, inner=inner))
        text = []

    tags = list(_Scanner(page).tags())
    skipped = _skipped(tags)
    at = i = 0
    while i < len(tags):
        t = tags[i]
        if t.start > at:
            text.append((page[at : t.start], bool(in_link)))
        at, i = t.end, i + 1
        close, name, attributes = t.close, t.name, t.attributes
        if not name:
            continue
        if not close and name in RAW:
            if i - 1 in skipped:
                last = skipped[i - 1]
                at, i = (tags[last].end, last + 1) if last < len(tags) else (len(page), last)
            text.append((" ", False))
            continue
        if name == "a":
            in_link = 0 if close else 1
        elif name == "br":
            text.append((" ", False))
        elif name in BREAKS:
            flush()
            heading = not close and name in ("h1", "h2", "h3", "h4", "h5", "h6")
            in_link = 0
        named = 0 if close or not attributes else _framed(name, attributes, bool(stack and stack[-1][2]))
        if named and name not in VOID and name not in BREAKS:
            flush()
        if name in VOID or not (name in HOLDERS or named or close):
            continue
        if not close:
            if name in ("article", "main") and not named:
                while stack and stack[-1][0] in ("nav", "header", "head"):  # left open
                    opened[stack.pop()[0]] -= 1
            _, framed, article, by_name, inner = stack[-1] if stack else ("", False, 0, False, False)
            if name in ("article", "main") and not framed and not article:
                articles += 1
                article, by_name, inner = articles, False, by_name
            stack.append((name, framed or named == 2 or (name in FRAME and not (name == "header" and article)), article, by_name or named == 1, inner))
            opened[name] += 1
        elif opened[name] > 0:
            if name not in BREAKS:
                flush()
            gone = ""
            while gone != name:
                gone = stack.pop()[0]
                opened[gone] -= 1
    tail = page[at:]
    if cut := _CUT_TAG.search(tail):  # a tag that the page's end cuts off
        tail = tail[: cut.start()]
    text.append((tail, bool(in_link)))
    flush()
    return out


def stop_density(text: str) -> float:
    words = text.translate(_STRIP).lower().split()
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def settle(found: list[Block]) -> None:
    """Whether articles inside holders with a name of the frame are the page's, and which names stand.

    They are where the page has no other article and they have at least half of the text outside of the
    frame; else, as lists of related articles, they belong to their holder.
    """
    free = [b for b in found if not b.framed and not b.named]
    theirs = sum(len(b.text) for b in free if b.inner)
    if any(b.article and not b.inner and not b.framed for b in found) or 2 * theirs < sum(len(b.text) for b in free):
        for b in found:
            if b.inner:
                b.article, b.named = 0, True
    for b in found:
        if b.named and not (len(b.text) >= LONG and b.linked <= NAMED_LINKS * len(b.text) and stop_density(b.text) >= STOP_HIGH):
            b.framed = True


def first_pass(b: Block, marked: bool) -> str:
    """``good``, ``bad``, or ``short`` and ``near`` where the block alone doesn't tell."""
    if b.framed or (marked and not b.article):
        return "bad"
    n = len(b.text)
    if b.linked / n > MAX_LINKS:
        return "bad"
    short, long, low, high = (MARKED_SHORT, MARKED_LONG, MARKED_LOW, MARKED_HIGH) if b.article else (SHORT, LONG, STOP_LOW, STOP_HIGH)
    if n < short:
        return "bad" if b.linked and not b.article else "short"
    density = stop_density(b.text)
    if density >= high:
        return "good" if n >= long else "near"
    if density >= low or n >= long:
        return "near"
    return "short" if b.article else "bad"


def second_pass(found: list[Block]) -> None:
    """Undecided blocks take the label of the nearest decided neighbours, within one article.

    Blocks of the page's frame decide nothing about others; where no block decides, and in an article of which
    no block is surely text, text is kept.
    """
    told = {b.article for b in found if b.article and b.label == "good"}
    sure = [b.label in ("good", "bad") and not b.framed for b in found]
    before, after = [None] * len(found), [None] * len(found)
    for order, into in ((range(len(found)), before), (range(len(found) - 1, -1, -1), after)):
        last = None
        for i in order:
            if last is not None and found[last].article != found[i].article:
                last = None
            into[i] = last
            if sure[i]:
                last = i
    for i, b in enumerate(found):
        if sure[i] or b.framed:
            continue
        sides = [(abs(j - i), found[j].label) for j in (before[i], after[i]) if j is not None]
        labels = {s for _, s in sides}
        if not sides or (b.article and b.article not in told):
            b.label = "good"
        elif len(labels) == 1:
            b.label = labels.pop()
        elif b.heading and after[i] is not None:
            b.label = found[after[i]].label
        elif sides[0][0] != sides[1][0]:
            b.label = min(sides)[1]
        else:
            b.label = "good" if b.article or b.label == "near" else "bad"


def main_text(page: str | None) -> str:
    """The article of a page; empty for null or a page without text."""
    found = blocks(page or "")
    settle(found)
    marked = any(b.article and not b.framed for b in found)
    for b in found:
        b.label = first_pass(b, marked)
    second_pass(found)
    return " ".join(b.text for b in found if b.label == "good")


def extract_main_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """All rows and columns of ``pages`` but ``column``, with ``text`` and ``n_chars`` (code points).

    Where ``pages`` has columns of these names, they stay and the new ones are ``text_`` and ``n_chars_``. Repeated
    rows stay; a null page is empty; an empty table gives an empty result.
    """
    kept = [c for c in pages.columns if c != column]
    names = [f"c{i}" for i in range(len(kept))]
    chosen = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)], F.col(column).cast("string").alias("page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*names, "text", "n_chars"])

    schema = chosen.drop("page").withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema
    others = pages.drop(column)
    return chosen.mapInArrow(run, schema).toDF(*kept, fresh(others, "text"), fresh(others, "n_chars"))


def query(spark, sf_dir: str) -> DataFrame:
    """``op1_extract_html``: the main text of all pages."""
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
