"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into text blocks at every tag that isn't inline. A block has its number of
words, its link density (share of words inside links), those of the blocks before and after
it, and the kind of markup that it stands in: heading, paragraph, list item or bare. A tree
is grown by information gain from :data:`LABELLED`, a small table of labelled blocks, when
first needed. Most labelled pages name no container, so these features decide; three hints
from containers are added, whose gain counts only :data:`HINT_WEIGHT` of a text feature's:
whether the block or a container of it is named as boilerplate (``nav``, ``class="ad"`` ...;
not counted where that would leave next to nothing of the page), whether it is inside main
content (``article`` ...), and whether it is outside of main content that has most of the
page's words.

Never shown: comments of the markup, scripts, styles, templates, form controls, media and
hidden elements. Character references are decoded after the tags are read, so ``&lt;b&gt;``
is text.

Defined results: null html is an empty page with empty text; pages without content blocks
give empty text; markup may be broken or end anywhere (an unfinished tag is dropped, an
unclosed element lasts to the end of its parent, an unclosed script, style, title or text
area to the end of the page); very long pages are read whole, in one pass; repeated rows are
treated alike; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.shared import batches_of, columns_of, place
from gleanery.session import ship_package

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|</?[A-Za-z][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([A-Za-z-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Tags that begin and end blocks; all others (unknown ones too) stand inside of lines.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their end tag, not markup, and is never shown on the page.
_RAW = frozenset("script style title textarea".split())
#: Never shown, or a form's control, or shown only where media can't be played.
_NEVER = frozenset("template svg iframe select button datalist canvas audio video".split())
_BOILER_TAGS = frozenset("nav aside footer form menu dialog fieldset".split())
_MAIN_TAGS = frozenset("article main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PARAGRAPHS = frozenset("p blockquote pre dd".split())
_ITEMS = frozenset("li dt".split())
#: An element that ends where one of the same group begins, and where that stops.
_GROUPS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"})}
#: Words of class, id and role that name boilerplate or main content.
_BOILER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement adbox adslot sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar side aside footer header masthead topbar toolbar comment comments commentlist disqus reply replies respond notice notices notification "
    "cookie cookies consent gdpr alert popup modal overlay share sharing social related recommended newsletter subscribe subscription signup login "
    "search pagination pager copyright legal disclaimer widget complementary contentinfo hidden".split()
)
_MAIN_NAMES = frozenset("article main content post entry story maincontent articlebody postbody entrycontent".split())
_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
#: ``has-sidebar``, ``no-ads``: these name what is beside the container, not the container.
_BESIDE = re.compile(r"(?i)(?<![a-z0-9])(?:has|with|without|no)[-_]+[a-z0-9_-]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    kind: str  # h: heading, t: paragraph, l: list item, d: bare
    boiler: bool
    main: bool

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def _hints(tag: str, attributes: str, in_main: bool) -> tuple[bool, bool, bool]:
    """(boilerplate, main, never shown) as the tag and its attributes say."""
    boiler = tag in _BOILER_TAGS or tag == "header" and not in_main
    main = tag in _MAIN_TAGS
    never = tag in _NEVER
    if attributes and tag not in ("body", "html"):
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "style" and _UNSEEN.search(value):
                never = True
            elif name == "aria-hidden" and value == "true":
                boiler = True
            elif name in ("class", "id", "role"):
                value = _BESIDE.sub(" ", value)
                names = {x.lower() for x in _NAME.findall(value)} | {x.lower() for x in value.split()}
                boiler |= bool(names & _BOILER_NAMES)
                main |= bool(names & _MAIN_NAMES)
    return boiler, main and not boiler, never


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # element, then boilerplate, main and never shown so far
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked: list[str] = []
    links = 0
    nothing = ("", False, False, False)

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            tag, boiler, main, never = stack[-1] if stack else nothing
            if not never:
                inside = len(" ".join(linked).split())
                words = text.count(" ") + 1
                kind = "h" if tag in _HEADINGS else "t" if tag in _PARAGRAPHS else "l" if tag in _ITEMS else "d"
                out.append(Block(text, words, min(words, inside), kind, boiler, main))
        parts.clear()
        linked.clear()

    def add(text: str) -> None:
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                linked.append(text)

    def push(tag: str, attributes: str) -> None:
        _, boiler, main, never = stack[-1] if stack else nothing
        own = _hints(tag, attributes, main)
        stack.append((tag, boiler or own[0], main or own[1], never or own[2]))
        opened[tag] += 1

    def pop_to(size: int) -> None:
        while len(stack) > size:
            opened[stack.pop()[0]] -= 1

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        closing, attributes = bool(m[1]), m[3]
        if tag in ("br", "hr"):
            parts.append(" ")
            continue
        if tag in _VOID:
            continue
        block = tag in _BLOCKS
        if not block and tag not in _RAW and tag not in _NEVER and not opened[tag] and (closing or not attributes or not _hints(tag, attributes, True)[2]):
            if tag == "a":
                links = 0 if closing else 1
            continue
        flush()
        if closing:
            if opened[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                pop_to(k)
                if block:
                    links = 0
        elif tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
        elif not (tag in _NEVER and attributes.rstrip().endswith("/")):
            if block and stack and (stack[-1][0] == "p" or stack[-1][0] in _HEADINGS):
                pop_to(len(stack) - 1)
            if tag in _GROUPS:
                same, limits = _GROUPS[tag]
                if any(opened[x] for x in same):
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] in same:
                            pop_to(k)
                            break
                        if stack[k][0] in limits:
                            break
            push(tag, attributes)
    flush()
    return out


#: Labelled blocks of small pages, a page a line. A block is container (b: named as
#: boilerplate, m: named as main content, p: neither), words, words in links, kind (h:
#: heading, t: paragraph, l: list item, d: bare), and + if it is main text. There are pages
#: with plain containers, misleading ones (all of the text in one named as boilerplate) and
#: mixed ones (lists of links inside main content; notices and comments beside plain text).
LABELLED = """
b1/1l b1/1l b1/1l b8/0d m9/0h+ m9/0t+ m120/0t+ m4/0t+ m80/3t+ m1/0t+ b7/0d
b2/2l b2/2l b3/3l m6/0h+ m45/2t+ m210/0t+ m3/0t+ m12/12t+ m66/1t+ b12/0d b4/4l
b5/5l b6/0d m2/0h+ m1/0t+ m2/0t+ m300/10t+ b25/0d b30/0d b9/9l
b40/0t m8/0h+ m22/0t+ m35/4t+ m5/0h+ m18/0t+ m2/2t+ m90/0t+ b60/2d b15/15l
p2/2l p1/1l p3/3l p7/0h+ p64/1d+ p120/4d+ p88/0d+ p41/0d+ p3/3l p2/2l p9/0d
p1/1l p1/1l p1/1l p12/0h+ p33/0t+ p150/2t+ p11/0t+ p77/0t+ p5/5l p6/2d
p4/4l p3/3l p6/0h+ p28/0d+ p17/0d+ p54/0d+ p101/9d+ p8/8l p7/7l p3/0d
p2/2l p10/10l p5/0h+ p75/0t+ p61/0t+ p95/12t+ p30/0t+ p2/2l p4/1d
p1/1l p2/2l p2/2l p200/0t+ p180/6t+ p160/0t+ p5/5l p5/5l p8/0d
b1/1l b1/1l p5/0d p3/0d m7/0h+ m52/0t+ m9/0t+ m140/0t+ p14/0d p20/2d b6/0d
b3/3l p22/0d p9/4d m11/0h+ m19/0t+ m27/27t+ m33/0t+ p45/0d p31/0d b2/2l
b4/0d b2/2l p12/0d m3/0t+ m2/0t+ m1/0t+ m6/0t+ p8/0d p11/0d b9/0d
p6/6l p2/0d p1/1l p9/0h+ p48/0d+ p39/3d+ p85/0d+ p2/2l p7/5d p4/0d
p3/3l p3/3l p3/3l p3/3l p4/0d p2/2l p2/2l p10/1d p3/3l
b8/8l b10/0d b120/0d b35/0t m10/0h+ m66/0t+ m70/0t+ b90/0d b110/0t b44/1d b3/3l
b2/2l m4/0h+ m16/16t+ m13/1t+ b50/0t m58/0t+ m24/0t+ b200/0d b150/0t
p1/0d p2/2l p8/0h+ p110/0t+ p34/0t+ p9/0t+ p57/0t+ p6/0d p2/2l p1/1l
b3/0d m5/0t+ m14/0t+ b2/2l m250/30t+ m7/0t+ b6/1d b70/0t
p2/2l p1/1l b25/0d p8/0h+ p64/1t+ p90/3t+ p3/0t+ p70/0t+ b40/0d b18/0d b6/2d
b1/1l b1/1l b31/0t p6/0h+ p44/0t+ p2/0t+ p58/2t+ p1/0t+ p105/0t+ b22/0d b9/9l
b45/3d p2/2l p9/0h+ p71/0t+ p4/0t+ p38/0t+ b65/0t b80/2d b54/0t p3/3l b14/0d
p1/1l p1/1l p5/0h+ p83/5t+ b16/0d p47/0t+ p6/0t+ p92/0t+ b28/0d p6/0d
b3/3l b2/2l p10/0h+ p29/0t+ p51/0t+ p36/0t+ b12/0d b33/0d b120/0t b7/7l
b2/2l b1/1l b9/0h+ b85/2t+ b120/3t+ b64/0t+ b7/0t+ b90/1t+ b3/3l b5/4d b4/0d
b1/1l b3/3l b6/0h+ b48/0d+ b73/6d+ b5/0t+ b132/0d+ b56/0d+ b2/2l b2/2l b9/2d
b4/4l b2/2l b7/0h+ b110/0t+ b39/1t+ b95/0t+ b3/0t+ b61/0t+ b6/6l b8/5d b3/0d
b1/1l m7/0h+ m62/0t+ m3/3l m5/5l m4/4l m77/2t+ m2/0t+ m54/0t+ b20/0d
b2/2l m5/0h+ m88/4t+ m41/0t+ m6/6l m8/8l m5/5l m7/7l b35/0t b3/3l
m9/0h+ m2/2l m2/2l m3/3l m120/0t+ m1/0t+ m18/18t+ m66/0t+ m4/4l m6/6l b9/0d
b1/1l m6/0h+ m34/0t+ m11/11t+ m52/3t+ m4/4l m4/4l m3/3l b60/0t
b5/5l m1/0h+ m1/0t+ m1/0t+ b6/0d b16/0d
b1/1l b1/1l b6/0d m3/0h+ m2/0t+ b24/0d b90/0t b16/0d
p3/3l p2/2l p11/0h+ p67/0t+ p4/4l p5/5l p6/6l p58/1t+ p2/0t+ p74/0t+ p4/4l p2/0d
p2/2l p2/2l p4/0h+ p99/0t+ p14/14t+ p87/2t+ p1/0t+ p63/0t+ p5/0d p3/3l
b1/1l b2/2l m6/0h+ m31/0t+ m70/2t+ m2/0t+
b2/2l b12/0d p6/0h+ p9/0t+ p22/0t+ p4/0t+ p11/0t+ p8/0t+ p31/0t+ p12/0t+ p6/0t+ p14/0t+ p3/0t+ p17/0t+ p5/0t+ b19/0d
b1/1l b2/2l p4/0h+ p13/1t+ p7/0t+ p1/0t+ p5/0t+ p26/0t+ p19/0t+ p2/0t+ p15/0t+ p20/0t+ p6/0t+ p11/0t+ b13/0d b2/2l
p2/2l p3/3l p8/0h+ p16/0t+ p5/0t+ p10/0t+ p23/2t+ p7/0t+ p12/0t+ p4/0t+ p18/0t+ p9/0t+ p41/0t+ p2/2l p3/3l
b1/1l b1/1l b9/0d p3/0h+ p2/0t+ p3/0t+ p14/0t+ p1/0t+ p2/0t+ p33/0t+ p6/0t+ p3/0t+ p9/0t+ p1/0t+ p5/0t+ p2/0t+ p48/0t+ p2/0t+ p7/0t+ b15/0d
b2/2l b7/0d p9/0h+ p8/0t+ p1/0t+ p1/0t+ p3/0t+ p24/0t+ p2/0t+ p4/0t+ p3/0t+ p11/0t+ p1/0t+ p17/0t+ p3/0t+ p10/0t+ p3/0t+ b18/0d
b1/1l b2/2l b8/0h+ b37/0t+ b52/0t+ b24/1t+ b3/3l
b5/5l b2/2l b3/0h+ b28/0t+ b6/0t+ b81/4t+ b19/0t+ b1/1l b1/1l
b1/1l b5/0h+ b43/2t+ b15/0t+ b66/0t+ b2/2l b1/1l
b1/1l m4/0h+ m80/0t+ m26/1t+ p9/0d
m5/0h+ m30/0t+ p2/0d
m8/0t+ p1/0d
b2/2l m3/0h+ m17/0t+ m44/0t+ p6/0d p4/0d
p9/0h+ p41/0t+
p6/0h+ p35/0t+ p120/3t+
b1/1l b2/2l p8/0h+ p74/2t+ p33/0t+ p28/0t+
p5/0h+ p62/0t+ p25/0t+ p57/0t+
b3/3l p4/0h+ p96/5t+
m5/0h+ m20/3t+ m4/0t+
b1/1l m4/0h+ m33/2t+ m9/0t+
b2/2l b1/1l m7/0h+ m12/3t+ m28/0t+
p7/0h+ p44/3t+ p31/0t+
b1/1l b8/0d p5/0h+ p6/0t+ p2/0t+ p7/0t+ p1/0t+ p3/0t+ p3/0t+ p9/0t+ p2/0t+ p1/0t+ p8/0t+ p3/0t+ p4/0t+ p2/0t+ p12/0t+ p1/0t+ p6/0t+ b17/0d
b2/2l b6/0d p2/0h+ p3/0t+ p1/0t+ p10/0t+ p2/0t+ p5/0t+ p3/0t+ p2/0t+ p1/0t+ p7/0t+ p3/0t+ p9/0t+ p2/0t+ p4/0t+ p1/0t+ p8/0t+ b21/0d
m5/0h+ m30/0t+ m14/14t+ m9/0t+
m6/0h+ m51/2t+ m4/4l m5/5l m3/0t+
b1/1l m4/0h+ m27/0t+ m5/5l m40/0t+
m1/0t+
m3/0t+
m4/0h+ m12/0t+ m1/0t+
b3/3l b2/2l p9/0h+ p48/0t+ p66/1t+ p27/0t+
p2/2l p1/1l p7/0h+ p59/2t+ p5/0t+ p83/0t+
b2/2l m5/0h+ m6/2t+ m40/1t+ m8/3t+ m3/1t+ m4/4l m5/5l m64/0t+ m5/2t+ b11/0d
m4/0h+ m7/2t+ m9/4t+ m6/6l m7/7l m3/3l m12/5t+ m4/1t+ b3/3l b30/0t
p5/0d p3/3l p3/3l p7/0h+ p55/0t+ p46/4t+ p3/0t+ p68/0t+ p9/9l p8/8l p7/0d
p1/1l p1/1l p8/0h+ p50/0t+ p5/0l+ p8/0l+ p12/0l+ p40/0t+ p6/1l+ p9/0l+ p2/2l p3/3l p9/0d
p2/2l p2/2l p5/0h+ p31/0t+ p4/0h+ p3/0l+ p7/0l+ p1/0l+ p66/2t+ p2/0h p3/3l p5/5l p4/4l p8/0d
p1/1l p1/1l p1/1l p1/1l p9/0d p12/0h+ p70/0t+ p1/0t+ p110/0t+ p11/0d
p1/1l p1/1l p1/1l p1/1l p12/0d p7/0h+ p3/0t+ p5/0t+ p2/0t+ p13/0d
p1/1l p1/1l p1/1l p6/0d p10/0h+ p250/0t+ p20/0t+ p15/0d
p3/3l p2/2l p6/0h+ p45/0t+ p3/0h+ p80/1t+ p4/0h+ p60/0t+ p1/0h p4/4l p6/6l p5/5l b26/0t b60/0t
b1/1l b2/2l p7/0h+ p55/0t+ p18/0t+ b2/0h b40/0t b12/0t b75/1t b8/0t
m6/0h+ m48/0t+ m90/2t+ m5/0t+ b3/0h b1/0t b20/0t b4/1d b55/0t
p2/2l p30/0d p6/0h+ p52/0t+ b2/0t p64/0t+ p3/0t+ b25/0t p2/2l
p1/1l p1/1l b28/0t b5/2d p9/0h+ p44/0t+ p2/0t+ p39/0t+ p7/7l p8/8l p11/0d
m7/0h+ m35/0t+ m4/0l+ m6/0l+ m9/0l+ m28/0t+ p34/0t p22/0t b2/2l
b1/1l m8/0h+ m75/0t+ m31/0t+ m110/0t+ p2/0h p40/0t p38/0t b10/0d
p2/2l p1/1l p1/1l p9/0h+ p60/0d+ p90/3d+ p120/0d+ p45/0d+ p4/4l p2/2l p12/0d
p3/3l p2/2l p7/0h+ p38/0d+ p25/0d+ p77/0d+ p31/0d+ b50/0d b33/0d p6/1d
b3/3l p5/0h+ p42/0d+ p58/0d+ b44/0d p66/0d+ p8/8l p10/0d
b2/0h b1/1l b1/1l b2/2l p7/0h+ p60/0t+ p2/0h+ p88/0t+ p45/1t+ p1/0h+ p120/0t+ b1/0h b4/4l b5/5l b9/0d
b1/0h b7/0d b1/1l b3/3l p5/0h+ p140/2t+ p3/0h+ p12/0t+ p96/0t+ p2/0h+ p31/0t+ b2/0h b33/0t b8/0t b2/0h b3/3l
b3/0h b2/2l p9/0h+ p75/0t+ p1/0h+ p64/0t+ p2/0h+ p150/4t+ p3/0h+ p110/0t+ p2/0h p3/3l p4/4l p2/2l b12/0d
b1/1h b5/0l b4/0l p6/0h+ p57/0t+ p3/0h+ p6/0l+ p9/0l+ p4/0l+ p2/0h+ p80/0t+ b2/0h b6/0l b9/0l b7/1l
b4/0h b1/1l b1/1l p8/0h+ p43/0t+ p6/0h+ p71/1t+ b5/0h b16/0t b2/0t b21/0t b3/0l b5/0l b10/0d
p2/0h p1/1l p2/2l p1/1l p10/0h+ p66/0t+ p2/0h+ p105/0t+ p3/0h p4/4l p6/6l p3/3l
p2/2l p1/1l p7/0h+ p60/0d+ p8/0d+ p72/1d+ p4/0d+ p95/0d+ p12/0d+ p48/0d+ p3/3l p9/0d
p1/1l p1/1l p5/0h+ p110/0d+ p3/0d+ p86/0d+ p10/0d+ p54/2d+ b44/0d p5/5l p4/0d
b6/0d b1/1l p6/0h+ p45/0d+ p6/0d+ p64/0d+ p2/0d+ p51/0d+ b9/0d b30/1d b2/2l
b3/0l b2/0l b4/0l m7/0h+ m50/0t+ m7/0l+ m3/0l+ m66/0t+ b2/0h b8/0l b6/0l b5/0d
m1/0d+
m2/0d+ b4/4l
b2/2l m6/0d+ m3/0d+ b9/0d
m9/0d+ m40/0d+ m2/0d+ b3/3l
b2/2t b3/3t b1/1t p6/0h+ p70/0t+ p12/12t+ p44/0t+ b4/4t b6/6t b15/0d
b1/1t b2/2t m8/0h+ m52/1t+ m9/9t+ m61/0t+ m2/0t+ b5/5t b3/3t
p2/2t p1/1t p3/3t p2/2t p9/0h+ p83/0t+ p10/10t+ p55/0t+ p3/3t p4/4t p2/2t p5/5t
m3/0d+
b2/2l m5/0d+
m2/0d+
b1/1l b1/1l m4/0h+ m7/0d+
p3/3l m12/0d+ m1/0d+
b4/0d b22/0t p3/0h+ p18/0t+ p41/0t+ p2/0h+ p25/0t+ b3/0d
b30/0t p2/0h+ p33/0t+ p2/0h+ p20/0t+ p1/0h+ p38/0t+ b2/0h b14/0t
m6/0h+ m40/0t+ m3/3t+ m51/0t+ m5/5t+ m33/0t+ b3/3t b4/4l
m5/0h+ m28/0t+ m4/4t+ m2/2t+ m60/0t+ b2/2t b2/2l
m9/0h+ m6/6t+ m70/1t+ m8/8t+ m1/1t+ b6/6t b9/0d
b1/1t b2/2t b30/0d p6/0h+ p47/0t+ p9/9t+ p52/0t+ b3/3t b41/0t b4/4t b60/0d
b2/2t b26/0t b3/3t b35/0d p5/0h+ p80/0t+ p33/0t+ b2/2t b28/0t
"""
_ROW = re.compile(r"([bmp])(\d+)/(\d+)([htld])(\+?)")
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "heading", "paragraph", "item", "boiler", "main", "beside_main")
HINTS = frozenset(("boiler", "main", "beside_main"))
#: What a hint's gain counts when the tree chooses a split.
HINT_WEIGHT = 0.5


def features(blocks: list[Block], hints: bool = True) -> list[tuple[float, ...]]:
    """A row of numbers per block; without ``hints`` as if no container had a name."""
    whole = sum(b.words for b in blocks)
    # Next to no words outside boilerplate: a container of the whole text must be misnamed.
    named = hints and 10 * sum(b.words for b in blocks if not b.boiler) > whole
    inside = [hints and b.main and not b.boiler for b in blocks]
    plain = sum(b.words - b.linked for b in blocks)
    most = 2 * sum(b.words - b.linked for b, i in zip(blocks, inside) if i) > plain
    sides = [(0, 0.0), *((b.words, b.density) for b in blocks), (0, 0.0)]
    return [
        (*sides[i + 1], *sides[i], *sides[i + 2], float(b.kind == "h"), float(b.kind == "t"), float(b.kind == "l"), float(named and b.boiler), float(inside[i]), float(most and not inside[i]))
        for i, b in enumerate(blocks)
    ]


def labelled_rows() -> list[tuple[tuple[float, ...], bool]]:
    rows = []
    for line in LABELLED.split("\n"):
        page = [Block("", int(w), int(k), kind, where == "b", where == "m") for where, w, k, kind, _ in _ROW.findall(line)]
        rows += zip(features(page), [bool(x[4]) for x in _ROW.findall(line)])
    return rows


def _entropy(yes: int, n: int) -> float:
    return -sum(p * math.log2(p) for p in (yes / n, 1 - yes / n) if p) if n else 0.0


def grow(rows: list[tuple[tuple[float, ...], bool]], depth: int = 9, least: int = 4):
    """A decision tree: a bool, or (feature, limit, tree for values <= limit, tree for greater ones)."""
    n, yes = len(rows), sum(y for _, y in rows)
    if not depth or yes in (0, n) or n < 2 * least:
        return 2 * yes > n
    best = None
    for f, name in enumerate(FEATURES):
        order = sorted(rows, key=lambda r: r[0][f])
        left = 0
        for i in range(1, n):
            left += order[i - 1][1]
            low, high = order[i - 1][0][f], order[i][0][f]
            if low == high or i < least or n - i < least:
                continue
            gain = _entropy(yes, n) - (i * _entropy(left, i) + (n - i) * _entropy(yes - left, n - i)) / n
            gain *= HINT_WEIGHT if name in HINTS else 1
            if best is None or gain > best[0] + 1e-12:
                best = gain, f, (low + high) / 2
    if best is None or best[0] < 3e-3:
        return 2 * yes > n
    _, f, limit = best
    low, high = (grow([r for r in rows if (r[0][f] > limit) == side], depth - 1, least) for side in (False, True))
    return low if isinstance(low, bool) and low == high else (f, limit, low, high)


@functools.cache
def trained_tree():
    return grow(labelled_rows())


def is_content(tree, row: tuple[float, ...]) -> bool:
    while not isinstance(tree, bool):
        f, limit, low, high = tree
        tree = low if row[f] <= limit else high
    return tree


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    tree = trained_tree()
    return " ".join(b.text for b, row in zip(blocks, features(blocks)) if is_content(tree, row))


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html_column: str = "html") -> DataFrame:
    """One row per page: key, url, text, n_chars."""
    ship_package(pages.sparkSession)
    kind = pages.schema.fields[place(pages, key)].dataType.simpleString()

    def run(batches):
        for batch in batches_of(batches):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["key", "url", "text", "n_chars"])

    rows = columns_of(pages, key=key, url=url, text=html_column).withColumn("url", F.col("url").cast("string"))
    return rows.mapInArrow(run, f"key {kind}, url string, text string, n_chars bigint").withColumnRenamed("key", key)
