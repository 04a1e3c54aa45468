"""Main text of web pages by tag-path ratios.

A page becomes a sequence of blocks in page order: runs of text between the edges of block elements. A block
belongs to its root-to-leaf path of tags and classes; equal paths are one node in the tree of paths.

1. Aggregate. Per path, and per subtree of paths: text length, punctuation, and the text in links.
2. Fuse. A ratio is the root of length times punctuation, times what is outside links, squared: much running text has a high ratio, a footer or an advert a low one, menus none.
3. Threshold. A block counts for as much as its path's ratio is above ``CONTENT`` of the best one, or against what it lies in for as much as it is below. The article is the smallest element that has
   nearly all of the largest sum, widened to headings beside it, to an ``article`` or ``main`` around it, and to other elements around it that add little but plain text. So short blocks, lists
   and tables of an article stay in it. A page whose best element is a menu has no article.
4. Smooth. Within the article a path's score is a mean of its own ratio and those of the two subtrees around it. What tags and class names say (a footer, an advert) makes a path suspect: it goes
   if its score, lowered by the name's factor, is below ``FOREIGN`` of the article's own ratio. Paths that no name makes suspect stay, whatever their ratio, and a suspect one with much running text stays too. Only comments,
   forms, menus and asides go by what they are called. In the choice of the article a name takes no more than ``BOUND`` leaves, but for comments.

The work is linear in the size of the page, whatever its depth.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from ledgerfold.llm.common import append_columns

# Tag classes of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript template iframe svg math object audio video canvas noembed noframes xmp".split())
#: Of these, what a slash at its end closes; to the others it means nothing.
CLOSABLE = set("svg math object audio video canvas template".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: A start tag ends an open element of the second set, unless one of the third is between.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}),
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
# What tags, roles and words in classes and ids multiply a score by.
TAG_FACTORS = {
    "nav": 0.05, "footer": 0.12, "menu": 0.05, "button": 0.05, "select": 0.05, "option": 0.05, "optgroup": 0.05, "datalist": 0.05, "input": 0.05, "dialog": 0.05, "fieldset": 0.07, "aside": 0.08, "form": 0.08, "header": 0.6,
}
#: Tags of elements that are no text to read, whatever else the page has.
CONTROLS = set("nav menu button select option optgroup datalist dialog".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
MARKS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted sidebar sidebars rail menu menus nav navbar navigation breadcrumb breadcrumbs "
    "footer foot header topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "widget widgets pagination pager toolbar masthead copyright skip search paywall teaser teasers outbrain taboola form".split()
)
#: Words that say nothing of their own beside a mark: ``related-links`` is as foreign as ``related``, ``recommended-dosage`` is not.
GENERIC = set(
    "a all area articles bar block bottom box bg btn button buttons center col column content container count cta element group header heading icon icons inner item items left link links list main module nav new news "
    "outer page pane panel posts primary right row secondary section site small stories sub text title top unit wide wrap wrapper zone js is has the with for of and by in to on".split()
)
#: Compound class names whose parts are no words of their own.
MARK_PARTS = re.compile(r"advert|sidebar|cookie|breadcrumb|newsletter|navbar|sponsor", re.I)
COMMENT = re.compile(r"comment", re.I)
COMMENT_NAMES = set("feedback replies reply respond responses disqus discussion discussions".split())
MARKED, COMMENTS = 0.12, 0.02

TOKEN = re.compile(r"<!--|<!\[CDATA\[|<[!?]|</?[a-zA-Z]")
TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：؟،·¿¡]")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
NUMBER = re.compile("[0-9]+")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Weights of a path's own ratio, its parent's and its grandparent's.
SMOOTH = (0.5, 0.3, 0.2)
CONTENT, FOREIGN = 0.2, 0.115
#: What a name leaves of a ratio, at the least, in the choice of the article; how much of the largest sum the article has; what an element around it may add in links and suspect text.
BOUND, NEARLY, STRANGE = 0.3, 0.98, 0.3
#: Paths with a lower factor are suspect.
SUSPECT = 0.5
#: Elements that hold an article whole, and those that hold the page.
HOLDERS, PAGES = {"article", "main"}, {"body", "html", "#root"}


def _marked(name: str) -> bool:
    """Whether a class or id is a mark: one of its words is, and the others say nothing of their own."""
    words = {w.lower() for w in WORDS.findall(name)}
    return bool(MARK_PARTS.search(name)) or bool(words & MARKS) and words <= MARKS | GENERIC


def factor(tag: str, attributes: dict[str, str], named: str) -> float:
    """What an element's tag and names say about the text in it."""
    out = TAG_FACTORS.get(tag, 1.0)
    if attributes.get("role", "").lower() in ROLES:
        out = min(out, MARKED)
    names = named.split()
    if COMMENT.search(named) or any({w.lower() for w in WORDS.findall(n)} <= COMMENT_NAMES | GENERIC and {w.lower() for w in WORDS.findall(n)} & COMMENT_NAMES for n in names):
        out = min(out, COMMENTS)
    elif any(map(_marked, names)):
        out = min(out, MARKED)
    return out


class Path:
    """A node of the tree of paths, with sums over its own blocks and then over its subtree: text, punctuation, text in links, blocks."""

    __slots__ = ("parent", "inner", "factor", "own", "all", "score")

    def __init__(self, parent: Path | None, factor: float):
        self.parent, self.factor = parent, factor * (parent.factor if parent else 1.0)
        self.inner: dict[str, Path] = {}
        self.own, self.all, self.score = [0, 0, 0, 0], [0, 0, 0, 0], 0.0


def ratio(sums: list[int]) -> float:
    """Length and punctuation of a path, fused, and what links leave of it."""
    text, marks, linked, blocks = sums
    return math.sqrt(text * (1 + marks)) * (1 - min(1.0, linked / max(1, text))) ** 2 if blocks else 0.0


class Element:
    __slots__ = ("tag", "parent", "holder", "path", "anchor", "hidden", "gain", "blocks", "headings", "text", "strange")

    def __init__(self, tag: str, parent: Element | None, path: Path, hidden: bool = False):
        self.tag, self.parent, self.path = tag, parent, path
        self.holder = parent.holder if parent and tag in INLINE else self
        self.anchor = tag == "a" or bool(parent and parent.anchor)
        self.hidden = hidden or bool(parent and parent.hidden)
        self.gain, self.blocks, self.headings, self.text, self.strange = 0.0, 0, 0, 0, 0


class Page:
    """A page's elements and paths (parents before children) and its blocks in order: (element, text, characters in links)."""

    def __init__(self, page: str):
        self.paths, self.elements, self.blocks = [Path(None, 1.0)], [], []
        self.elements.append(Element("#root", None, self.paths[0]))
        self._read(page)

    def _open(self, tag: str, attributes: dict[str, str], parent: Element) -> Element:
        path = parent.path
        if tag not in INLINE:
            named = f"{attributes.get('class', '')} {attributes.get('id', '')}".strip()
            # what makes an element foreign is part of the step; numbers and ids, which make every element another, are not
            f = factor(tag, attributes, named)
            step = f"{tag}.{NUMBER.sub('', attributes.get('class', ''))}:{f}"
            if (found := path.inner.get(step)) is None:
                found = path.inner[step] = Path(path, f)
                self.paths.append(found)
            path = found
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(INVISIBLE.search(attributes.get("style", "")))
        self.elements.append(Element(tag, parent, path, hidden))
        return self.elements[-1]

    def _read(self, page: str) -> None:
        stack, run, held = [self.elements[0]], [], Counter()

        def end_block() -> None:
            if run:
                if text := " ".join("".join(t for t, _ in run).split()):
                    self.blocks.append((stack[-1].holder, text, sum(len(t.strip()) for t, linked in run if linked)))
                run.clear()

        def cut(i: int) -> None:
            held.subtract(e.tag for e in stack[i:])
            del stack[i:]

        def add(text: str) -> None:
            if text and not stack[-1].hidden:
                run.append((entities.unescape(text) if "&" in text else text, stack[-1].anchor))

        at, size = 0, len(page)
        while at < size:
            found = TOKEN.search(page, at)
            if not found:
                add(page[at:])
                break
            add(page[at : found.start()])
            at, kind = found.start(), found[0]
            if kind == "<!--":
                end = page.find("-->", at + 2)
                at = size if end < 0 else end + 3
                continue
            if kind == "<![CDATA[":
                end = page.find("]]>", at)
                add(page[at + 9 : end if end >= 0 else size].replace("&", "&amp;"))
                at = size if end < 0 else end + 3
                continue
            if kind in ("<!", "<?"):
                end = page.find(">", at)
                at = size if end < 0 else end + 1
                continue
            tag = TAG.match(page, at)
            if not tag:
                if page.find(">", at) < 0:  # the page ends inside a tag
                    break
                at = page.find(">", at) + 1  # stray quotes
                continue
            name, at = tag[1].lower(), tag.end()
            if kind.startswith("</"):
                if name not in INLINE:
                    end_block()
                for i in range(len(stack) - 1, 0, -1) if held[name] else ():
                    if stack[i].tag == name:
                        cut(i)
                        break
                    if name in INLINE and stack[i].tag not in INLINE:
                        break
                continue
            if name == "br":
                add("\n")
                continue
            if name in VOID:
                if name not in ("img", "wbr", "input"):
                    end_block()
                continue
            attributes = {(a[1] or a[5]).lower(): entities.unescape(a[2] or a[3] or a[4] or "") for a in ATTR.finditer(tag[2])} if tag[2] else {}
            if name in RAW and not (name in CLOSABLE and tag[2].rstrip().endswith("/")):
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else size
                continue
            if name not in INLINE:
                end_block()
                ends, bar = SIBLINGS.get(name, ((), ()))
                if name in CLOSES_P:
                    ends, bar = {"p"}, {"div", "article", "section", "main", "aside", "td", "li", "blockquote", "body", "form", "nav", "header", "footer"}
                for i in range(len(stack) - 1, 0, -1) if any(held[x] for x in ends) else ():
                    if stack[i].tag in ends:
                        cut(i)
                        if name not in ("tr", "tbody", "tfoot"):
                            break
                    elif stack[i].tag in bar:
                        break
            stack.append(self._open(name, attributes, stack[-1]))
            held[name] += 1
        end_block()


def _heaviest(page: Page, weights: dict[int, float]) -> Element:
    """The smallest element with nearly all of the largest sum of what blocks count; of equal ones the innermost."""
    best = max(weights.values())
    for e in page.elements:
        e.gain = 0.0
    for e, _, _ in page.blocks:
        e.gain += weights[id(e.path)] / best - CONTENT
    for e in reversed(page.elements[1:]):
        e.parent.gain += e.gain
    most = max(e.gain for e in page.elements)
    node = min((e for e in page.elements if e.gain >= NEARLY * most), key=lambda e: e.blocks)
    for e in page.elements:  # parents come first
        if e.blocks == node.blocks and e.gain == node.gain:
            node = e
    return node


def _article(page: Page) -> Element | None:
    """The element that is the article; None if the best one is a control."""
    paths = [p for p in page.paths if p.own[3]]
    weights = {id(p): ratio(p.own) * max(BOUND, p.factor) for p in paths}
    if max(weights.values()) <= 0:  # nothing but links
        return None
    comments = {id(p) for p in paths if p.factor <= COMMENTS}
    if any(w > 0 for k, w in weights.items() if k not in comments):
        weights |= dict.fromkeys(comments, 0.0)
    for e, text, linked in page.blocks:
        e.blocks += 1
        e.headings += e.tag in HEADINGS
        e.text += len(text)
        e.strange += len(text) if e.path.factor < SUSPECT else min(linked, len(text))
    for e in reversed(page.elements[1:]):
        for what in ("blocks", "headings", "text", "strange"):
            setattr(e.parent, what, getattr(e.parent, what) + getattr(e, what))
    node = _heaviest(page, weights)
    clear = {id(p): ratio(p.own) if p.factor >= SUSPECT else 0.0 for p in paths}
    if node.path.factor < SUSPECT and max(clear.values()) >= BOUND / 3 * max(ratio(p.own) for p in paths):
        node = _heaviest(page, clear)  # of a page with next to no text the footer is not the article
    up = node
    while up is not None:
        if up.tag in CONTROLS:
            return None
        up = up.parent
    around = node
    while around.parent is not None:  # the outermost holder that the rules reach
        around = around.parent
        text, strange = around.text - node.text, around.strange - node.strange
        if around.tag in HOLDERS or around.blocks - node.blocks == around.headings - node.headings or (around.tag not in PAGES and strange <= STRANGE * text):
            node = around
    return node


def content(page: Page) -> list[str]:
    """Texts of the blocks that are content."""
    for e, text, linked in page.blocks:
        for i, x in enumerate((len(text), len(PUNCTUATION.findall(text)), linked, 1)):
            e.path.own[i] += x
    for p in reversed(page.paths):
        p.all = [x + y for x, y in zip(p.own, p.all, strict=True)]
        if p.parent:
            p.parent.all = [x + y for x, y in zip(p.parent.all, p.all, strict=True)]
    top = _article(page)
    if top is None:
        return []
    inside = {id(top)}
    for e in page.elements:  # parents come first
        if e.parent is not None and id(e.parent) in inside:
            inside.add(id(e))
    blocks = [(e, text) for e, text, _ in page.blocks if id(e) in inside]
    for p in {id(e.path): e.path for e, _ in blocks}.values():
        above = p if p is top.path else p.parent or p
        further = above if above is top.path else above.parent or above
        p.score = SMOOTH[0] * ratio(p.own) + SMOOTH[1] * ratio(above.all) + SMOOTH[2] * ratio(further.all)
    whole = ratio(top.path.all)
    named = lambda p: p.factor / top.path.factor
    return [text for e, text in blocks if named(e.path) >= 1 or named(e.path) * e.path.score >= FOREIGN * whole]


def main_text(page: str | None) -> str:
    """The article's blocks, joined by newlines; '' for null, empty and text-free pages."""
    read = Page(page) if page else None
    return "\n".join(content(read)) if read and read.blocks else ""


def extract_main_text(pages: DataFrame, *, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``pages`` without ``html``, with the main text of each page and its length in code points.

    Blocks come in page order, one a line; character references are decoded, white space inside a block becomes one space. A
    null or empty page, or one without text, gives ''. Pages that end inside a tag lose that tag only. Nothing
    is cut from long pages. Repeated rows stay repeated; other columns pass through, and columns named like the
    two results are replaced. Of elements that count alike the smallest, then the innermost, is the article. An empty table gives an empty result. No row depends on another: there is no shuffle.
    """

    def start():
        def work(found: list[str | None]) -> tuple[list, list]:
            texts = [main_text(x) for x in found]
            return texts, [len(x) for x in texts]

        return work

    return append_columns(pages, [html], f"{text} string, {n_chars} long", start, omit=(html,))
