"""Main-text extraction from HTML by two passes of block rules.

The first pass judges blocks by stop-word density, length and link density: long
blocks rich in stop words are text, blocks made of links and long blocks without stop
words are not. An article or main element is evidence, which moves these thresholds:
shorter blocks with fewer stop words are text inside of it, and only long ones with
many are outside of it. Elements, roles and whole class names that stand for something
else (asides, forms, adverts, comments ...) are evidence against: they keep their blocks
out, unless they hold all articles of the page, or the page has no text without them.
Menus, footers and hidden elements never hold text. The second pass gives open blocks
the label of their nearest decided neighbours, in the same article or outside of all.
Where most of a page's long blocks have hardly any stop words, its language has none
here, and length and link density judge alone. An article without any decided text is
text if it has a long block, or if the page has no other text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenflow.llm.common import col

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?!title[^>]*/>)(?P<raw>script|style|textarea|title)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Elements that end a block, that hold others, and that never hold text of the article.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub "
    "sup time tt u var wbr br input label meta link base col source track area embed param".split()
)
CONTAINERS = frozenset(
    "html body article main section div nav header footer aside form ul ol dl li dt dd table thead tbody tfoot tr td th figure "
    "figcaption blockquote pre details summary dialog menu fieldset address center a".split()
)
#: Elements whose content is no text of the page; one that is never closed ends at the next block.
SKIPPED = frozenset("button select object svg iframe noscript template".split())
BREAKS = (CONTAINERS - {"a"}) | frozenset("p h1 h2 h3 h4 h5 h6 hr".split())
NEVER, AGAINST = frozenset("nav footer menu head".split()), frozenset("aside form dialog fieldset".split())
NEVER_ROLES = frozenset("navigation contentinfo menu menubar toolbar".split())
AGAINST_ROLES = frozenset("banner complementary search form dialog alert alertdialog".split())
OUTSIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion banner banners menu menus nav "
    "navbar navigation breadcrumb breadcrumbs sidebar sidebars footer footnav masthead topbar cookie cookies consent notice notices gdpr "
    "newsletter subscribe subscription signup login popup modal overlay comment comments commentlist reply replies respond disqus share "
    "sharing social related recommended recommendations widget widgets toolbar pagination pager copyright disclaimer alert".split()
)
#: Parts of class names that say nothing of their own beside one of the above.
PLAIN_NAMES = frozenset(
    "area articles bar block box button buttons col column container entries form global group heading icons inner item items left link "
    "links list main outer page panel post posts primary right row secondary section site slot stories text title top unit wrap wrapper".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist reply replies respond disqus".split())
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his i if in is it its not of on or our she so that the their they "
    "this to was we were what when which who will with you your "
    "aber als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer es für hat ich im in ist mit nach nicht "
    "noch oder sich sie sind so und uns von war wie wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa "
    "se ses son sont sur un une vous "
    "al como con de del el ella en entre era es esta este fue ha la las lo los más no o para pero por que se ser sin sobre su sus un "
    "una y".split()
)
WORD = re.compile(r"\w+")
#: Pass one: long enough to judge, long enough to be text, and the densities asked for.
SHORT, LONG, STOP_LOW, STOP_HIGH, LINKS = 70, 140, 0.10, 0.25, 0.5
TEXT, OTHER, OPEN = 1, 0, None
#: Scripts that need about three times fewer characters for a text.
DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Block(NamedTuple):
    """A block of text. ``against`` numbers the elements around it that speak against it."""

    text: str
    links: int
    outside: bool
    against: tuple[int, ...]
    article: int
    item: bool
    heading: bool
    code: bool


def stands_for(names: str, wanted: frozenset) -> bool:
    """Whether one whole class name is made of wanted words, with nothing but plain ones beside them."""
    for name in names.split():
        parts = [p.lower() for p in NAME_PART.findall(name)]
        if any(p in wanted for p in parts) and all(p in wanted or p in OUTSIDE_NAMES or p in PLAIN_NAMES for p in parts):
            return True
    return False


class Verdict(NamedTuple):
    """What an element says of its content: that it never is text, or evidence against it; and if as readers' comments."""

    never: bool = False
    against: bool = False
    comment: bool = False


def verdict(tag: str, attrs: str, in_article: bool) -> Verdict:
    never, against = tag in NEVER, tag in AGAINST or (tag == "header" and not in_article)
    if not attrs.strip():
        return Verdict(never, against)
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attrs)}
    role = values.get("role", "").lower()
    bare = ATTRIBUTE.sub(" ", attrs).lower().split()
    hidden = "hidden" in bare or "hidden" in values or values.get("aria-hidden", "").lower() == "true"
    never |= hidden or role in NEVER_ROLES or re.search(r"display\s*:\s*none", values.get("style", ""), re.I) is not None
    if tag in ("html", "body", "main"):
        return Verdict(never, against)
    names = f"{values.get('class', '')} {values.get('id', '')}"
    comment = stands_for(names, COMMENT_NAMES)
    if tag == "article":
        return Verdict(never, comment, comment)
    against |= role in AGAINST_ROLES or stands_for(names, OUTSIDE_NAMES) or (not in_article and stands_for(names, frozenset(["header"])))
    return Verdict(never, against, comment)


class Open(NamedTuple):
    """An open element, with what it and those around it say about their text.

    ``article`` is the number of the innermost article or main element, 0 without one.
    """

    tag: str
    outside: bool
    against: tuple[int, ...]
    article: int
    item: bool
    link: bool
    code: bool


def skips(tokens: list[re.Match], end: int) -> dict[int, tuple[int, int]]:
    """For each token that opens a skipped element, where to go on: the token, and the place in the page."""
    opened: dict[str, list[int]] = {}
    out: dict[int, tuple[int, int]] = {}
    for i, m in enumerate(tokens):
        tag = (m["tag"] or "").lower()
        if tag not in SKIPPED:
            continue
        if m["close"]:
            if opened.get(tag):
                out[opened[tag].pop()] = i + 1, m.end()
        elif not m["attrs"].rstrip().endswith("/"):
            opened.setdefault(tag, []).append(i)
    loose = {i for places in opened.values() for i in places}
    after = len(tokens), end
    for i in range(len(tokens) - 1, min(loose, default=len(tokens)) - 1, -1):
        if i in loose:
            out[i] = after
        elif (tokens[i]["tag"] or "").lower() in BREAKS:
            after = i, tokens[i].start()
    return out


def blocks(page: str) -> list[Block]:
    """The page's blocks of text, with what pass one needs to know about each."""
    out: list[Block] = []
    root = Open("", False, (), 0, False, False, False)
    # Of the elements that speak against their content: the articles in them, and whether they are comments.
    held: dict[int, set[int]] = {}
    comments: set[int] = set()
    stack = [root]
    parts: list[str] = []
    linked, heading, marked, articles, at = 0, False, Verdict(), 0, 0

    def flush() -> int:
        text = " ".join("".join(parts).split())
        if text:
            here = stack[-1]
            against = here.against
            if marked.against:
                held[len(held) + 1] = set()
                against = (*against, len(held))
            out.append(Block(text, linked, here.outside or marked.never, against, here.article, here.item, heading, here.code))
        parts.clear()
        return 0

    def add(text: str) -> int:
        text = html.unescape(text) if "&" in text else text
        parts.append(text)
        return len(" ".join(text.split())) if stack[-1].link else 0

    tokens = list(TOKEN.finditer(page))
    past, resume = skips(tokens, len(page)), 0
    for i, m in enumerate(tokens):
        if i < resume:
            continue
        if m.start() > at:
            linked += add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if i in past:
            resume, at = past[i]
        if not tag or tag in SKIPPED:
            continue
        if tag == "br":
            parts.append(" ")
        if tag not in INLINE:
            linked = flush()
            heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6") and not m["close"]
            # A paragraph or heading isn't kept open: what it says holds until the block ends.
            marked = verdict(tag, m["attrs"], True) if tag not in CONTAINERS and not m["close"] else Verdict()
        if m["close"]:
            if tag in CONTAINERS:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
        elif tag in CONTAINERS and not m["attrs"].rstrip().endswith("/"):
            if tag in ("li", "tr", "td", "th", "dt", "dd", "a") and stack[-1].tag == tag:
                stack.pop()
            up = stack[-1]
            own = tag in ("article", "main")
            articles += own
            said = verdict(tag, m["attrs"], up.article > 0)
            against = up.against
            if said.against:
                held[len(held) + 1] = set()
                against = (*against, len(held))
                comments |= {len(held)} if said.comment else set()
            for number in against if own else ():
                held[number].add(articles)
            stack.append(Open(
                tag,
                up.outside or said.never,
                against,
                articles if own else up.article,
                up.item or tag in ("li", "td"),
                up.link or tag == "a",
                up.code or tag == "pre",
            ))
    if at < len(page):
        linked += add(page[at:])
    flush()
    return weighed(out, held, comments, articles)


def length(text: str) -> int:
    """Characters, those of dense scripts counted three times."""
    return len(text) + 2 * len(DENSE.findall(text))


def density(text: str) -> float:
    """The share of stop words."""
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(len(words), 1)


def is_prose(text: str) -> bool:
    """Long, or not short and rich in stop words."""
    return length(text) >= LONG or (length(text) >= SHORT and density(text) >= STOP_HIGH)


def weighed(found: list[Block], held: dict[int, set[int]], comments: set[int], articles: int) -> list[Block]:
    """The blocks, with ``outside`` set where the evidence against them stands.

    It does not stand for an element that holds every article of the page, unless as
    comments. While no prose and no block of an article is left, the evidence of the
    element with the most prose falls, that of comments last.
    """
    standing = {k for k in held if k in comments or not articles or len(held[k]) < articles}
    if standing:
        prose = [b for b in found if not b.outside and is_prose(b.text) and b.links <= LINKS * len(b.text)]
        sizes = {k: sum(length(b.text) for b in prose if k in b.against) for k in standing}
        told = [*prose, *(b for b in found if b.article and not b.outside and b.links <= LINKS * len(b.text))]
        while any(sizes[k] for k in standing) and all(standing.intersection(b.against) for b in told):
            standing.remove(max((k for k in standing if sizes[k]), key=lambda k: (k not in comments, sizes[k], -k)))
    return [b._replace(outside=b.outside or bool(standing.intersection(b.against))) for b in found]


def knows_language(found: list[Block]) -> bool:
    """Whether stop words can judge the page: at least half of its long blocks' text has some."""
    sizes = [0, 0]
    for b in found:
        if not (b.outside or b.heading or b.code) and length(b.text) >= LONG and b.links <= LINKS * len(b.text):
            sizes[density(b.text) >= STOP_LOW] += length(b.text)
    return sizes[1] >= sizes[0]


def first_pass(block: Block, has_article: bool, known: bool = True) -> int | None:
    if block.outside:
        return OTHER
    links = block.links / len(block.text)
    if links > LINKS:
        return OTHER if block.item or not block.article else OPEN
    if length(block.text) < SHORT or block.heading or block.code:
        return OPEN
    stops = density(block.text)
    long = length(block.text) >= LONG
    if not known and not block.article:
        text, other = long and not has_article, False
    elif block.article:
        text, other = stops >= STOP_LOW, stops == 0 and long
    elif has_article:
        text, other = stops >= STOP_HIGH and long, stops < STOP_LOW and long
    else:
        text, other = stops >= STOP_HIGH or (stops >= STOP_LOW and long), stops < STOP_LOW and long
    return TEXT if text else OTHER if other else OPEN


def second_pass(found: list[Block], labels: list[int | None]) -> list[int]:
    """Open blocks take the label of the nearest decided block; a heading that of the next one.

    At equal distance text wins over the rest. Inside an article only blocks
    between two that are not text are left out. Blocks without any decided one
    are all text.
    """
    n = len(labels)
    before, after = [-1] * n, [n] * n
    for i in range(n):
        before[i] = i if labels[i] is not OPEN else before[i - 1] if i else -1
    for i in reversed(range(n)):
        after[i] = i if labels[i] is not OPEN else after[i + 1] if i + 1 < n else n
    out = []
    for i, label in enumerate(labels):
        if label is OPEN:
            back, ahead = before[i], after[i]
            if back < 0 and ahead == n:
                label = TEXT
            elif found[i].article:
                label = OTHER if back >= 0 and ahead < n and labels[back] == labels[ahead] == OTHER else TEXT
            elif back < 0 or (found[i].heading and ahead < n):
                label = labels[ahead]
            elif ahead == n or i - back < ahead - i:
                label = labels[back]
            else:
                label = labels[ahead] if ahead - i < i - back else max(labels[back], labels[ahead])
        out.append(label)
    return out


def labelled(found: list[Block]) -> list[int]:
    """The label of every block, after both passes."""
    groups: dict[int, list[int]] = {}
    for i, b in enumerate(found):
        # Menus and lists of links inside an article say nothing about the blocks beside them.
        if not b.article or not (b.outside or (b.item and b.links > LINKS * len(b.text))):
            groups.setdefault(b.article, []).append(i)
    known = knows_language(found)
    labels = [first_pass(b, True, known) for b in found]
    size = lambda places, label: sum(length(found[i].text) for i in places if labels[i] == label)
    full = set()
    for g, places in groups.items():
        if g and size(places, TEXT) <= size(places, OTHER):
            # Long blocks without stop words are most of it: its language has none here, so they decide nothing.
            for i in places:
                labels[i] = OPEN if labels[i] == OTHER else labels[i]
        if g and (size(places, TEXT) or any(length(found[i].text) >= LONG for i in places)):
            full.add(g)
    if not full:
        labels = [label if b.article else first_pass(b, False, known) for b, label in zip(found, labels, strict=True)]
    some_text = bool(full) or TEXT in labels
    out = [OTHER if x is OPEN else x for x in labels]
    for g, places in groups.items():
        mine = [labels[i] for i in places]
        if all(x is OPEN for x in mine) and (g in full if g else not full):
            mine = [TEXT] * len(places)
        elif all(x is OPEN for x in mine):
            mine = [OTHER if some_text else TEXT] * len(places)
        else:
            mine = second_pass([found[i] for i in places], mine)
        for i, label in zip(places, mine, strict=True):
            out[i] = label
    return out


def main_text(page: str | None) -> str:
    """The article's blocks in page order, joined by an empty line."""
    found = blocks(page or "")
    return "\n\n".join(b.text for b, label in zip(found, labelled(found), strict=True) if label == TEXT)


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with the html column replaced by ``text``, the main text.

    Pages are read whole; null and empty pages, and pages without article text,
    give an empty text. Character references are decoded, white space inside a
    block becomes one space. Broken markup is read as far as it goes. Repeated
    rows each give a row, an empty table an empty result. A column of the input
    that is called ``text`` gives way to the result.
    """

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(main_text)

    keep = [col(c) for c in pages.columns if c.lower() not in (html_col.lower(), "text")]
    return pages.select(*keep, F.pandas_udf(run, "string")(F.coalesce(col(html_col), F.lit(""))).alias("text"))
