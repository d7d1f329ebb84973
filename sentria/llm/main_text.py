"""Main text of web pages by composite text density.

A tolerant tokenizer builds the element tree in one pass. For every block the
composite text density is computed: characters for each tag, lowered where
characters and tags belong to links. The densities of a node's children are
summed, and the container with the largest sum is the core; ``article`` and
``main`` count double. A single container that holds nearly all text of the
core stands for it, and so does an article in it with most of its text. From the core the path leads up to the body. The threshold
is two thirds of the larger of two figures: the smallest density on this path, and
the median density of the core's parts (of a paragraph of ``PARAGRAPH`` characters
at most). Containers in the core, and blocks beside the path, that reach the threshold belong to the
result. Below it, a container is searched for denser ones. Running
text (paragraphs, lists, tables) that isn't mostly links belongs to it in the core, in what is dense, and beside
such running text; a heading with what follows it.

What speaks against a block lowers its density, and nothing else: each of its
characters counts as a part of one (``WEIGHTS``). That are names ("cookie-notice", "comment-list"),
page headers, short texts outside of paragraphs that begin like notices ("Copyright", "Share this"), and being outside of article elements that hold most of the page's text. A name that may be a container's own
("widget", "banner") weighs less where the block holds most of the page's text, and nothing where it holds all.
A name counts if a class, id or role ends in it, or begins
with it and goes on with a word for a container: "has-sidebar",
"comments-open", "post--with-sidebar" and "social-science" name nothing. Blocks in the header of an article
need a part of a paragraph's density (``HEADER``), by names such as "lead" still less.

Only what is no text of the page, or no part of an article by its very tag, goes
before that: scripts, styles, form controls, navigation, asides, footers, and what is hidden.

Inline elements count as tags of their block, not as nodes of their own, so
that a bold paragraph isn't taken for a container.

Defined cases: null and empty pages give an empty text, and so do pages without
text outside of what is cut; unclosed, misnested and unknown tags and a page
without a body are allowed; a tag that isn't closed ends before the next one;
repeated rows each keep a row; an empty table gives
an empty result; extra columns are ignored. Work is in proportion to the page, whatever its markup.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import batch_of, rows_of, small_batches

#: Comments, declarations, tags. A tag ends at ``>``, or before a ``<`` outside of quotes; a quote without its other half is none.
TOKEN = re.compile(r"<!--(?:.*?)(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/><]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>?", re.DOTALL)
CLUES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(f"</{t}(?=[\\s/>])", re.IGNORECASE | re.ASCII) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
CUT = frozenset("script style noscript template iframe object embed svg math canvas audio video button select textarea input option datalist dialog nav aside footer menu head title xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
#: Start tags that end an open sibling, and the containers beyond which they don't look.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ARTICLE = frozenset({"article", "main"})
#: Running text: parts of an article, but never the container of one.
FLOW = frozenset("p ul ol dl li dt dd blockquote pre table thead tbody tfoot tr caption figure figcaption details summary address hr".split()) | HEADINGS
#: Words that name what is no article, unless it has most of the text.
NO_ARTICLE = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar widget widgets footer masthead comment comments commentlist disqus replies respond share sharing social related recommended recommendations toolbar pagination pager "
    "login search complementary contentinfo".split()
)
#: Those that hold text of their own kind, of which a page may have more than of the article.
OTHERS = frozenset("comment comments commentlist disqus replies respond related recommended recommendations".split())
#: Those that name no article whatever follows.
ALWAYS = frozenset("cookie cookies gdpr consent newsletter advert adverts advertisement advertising adsense sponsored disqus breadcrumb breadcrumbs popup modal".split())
#: Those that name no article however much text there is.
CERTAIN = OTHERS | ALWAYS | frozenset("ad ads adbox sponsor promo notice notices sidebar menu nav navbar navigation footer subscribe subscription signup login pagination pager".split())
LEADS = frozenset("lead lede standfirst subtitle subhead dek deck intro summary excerpt description abstract".split())
#: What a character counts in blocks of such names, of other names above (at least), in page headers, in texts like notices, and outside of articles that hold most of the text.
WEIGHTS = {"certain": 0.01, "named": 0.2, "header": 0.2, "notice": 0.05, "outside": 0.2}
#: How short texts begin that are no part of an article.
NOTICE = re.compile(r"\W*(?:copyright\b|\u00a9|all rights reserved|share (?:this|on|it)\b|follow us\b|advertisement\b|sponsored\b|(?:related|recommended) (?:articles|posts|stories)\b|tags?\s*:|filed under\b|leave a (?:reply|comment)\b|\d+ comments?\W*\Z)", re.IGNORECASE)
NOTICE_CHARACTERS = 80
#: What may follow such a word in the name of a container, and what makes a name one of a state.
CONTAINERS = frozenset(
    "area articles bar block body box button buttons column container content count feed form group heading headlines holder icon icons inner item items left link links list main news next outer panel posts previous products region right row "
    "section slot stories strip text thread title top topics bottom unit wrap wrapper".split()
)
STATES = frozenset("has with without no not is hide show enable disable".split())
#: Characters of the paragraph that the threshold asks for at most.
PARAGRAPH = 200
#: Share of the text outside of links that a child needs to stand for the core.
NEARLY_ALL = 0.8
#: Part of the density of a paragraph that blocks in the header of an article need, and by how much names of leads multiply theirs.
HEADER, LEAD = 0.13, 4


def _parts(name: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w and not w.isdigit()]


def _is_lead(attributes: str) -> bool:
    return any(w in LEADS for m in CLUES.finditer(attributes) for w in _parts(m[1] or m[2] or m[3] or ""))


def named(attributes: str) -> frozenset[str]:
    """Which words of ``NO_ARTICLE`` the classes, id and role name.

    Of names like ``block__element--modifier``, block and element are looked at each by itself.
    """
    found = set()
    for m in CLUES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            for parts in map(_parts, name.partition("--")[0].split("__")):
                if not parts or parts[0] in STATES:
                    continue
                if parts[-1] in NO_ARTICLE:
                    found.add(parts[-1])
                elif parts[0] in ALWAYS or parts[0] in NO_ARTICLE and CONTAINERS.issuperset(parts[1:]):
                    found.add(parts[0])
    return frozenset(found)


class Page:
    """The element tree in arrays; a parent comes before its children."""

    def __init__(self, source: str):
        self.tag: list[str] = ["html"]
        self.parent: list[int] = [-1]
        self.cut: list[bool] = [False]
        #: what its names, or it being a page's header, make a character of the node count; names that the text may outweigh are marked
        self.weight: list[float] = [1.0]
        self.outweighed: list[bool] = [False]
        self.in_article: list[bool] = [False]
        #: blocks in the header of an article, headings aside: 1, or ``LEAD`` for leads
        self.in_header: list[int] = [0]
        #: (node, text) in page order; None for the edge of a block
        self.items: list[tuple[int, str | None]] = []
        self._build(source)

    def _add(self, parent: int, tag: str, attributes: str) -> int:
        node = len(self.tag)
        cut = self.cut[parent] or tag in CUT
        weight, outweighed, header = 1.0, False, 0
        if not cut and len(attributes) > 5 and tag not in ("html", "body"):
            cut = bool(HIDDEN.search(attributes))
            if names := named(attributes):
                if names & CERTAIN and not (tag in ARTICLE and not names & OTHERS):
                    weight = WEIGHTS["certain"]
                elif tag not in ARTICLE:
                    weight, outweighed = WEIGHTS["named"], True
        if tag == "header" and not self.in_article[parent]:
            weight, outweighed = min(weight, WEIGHTS["header"]), weight == 1.0
        elif self.tag[parent] == "header" and self.in_article[parent] and tag not in HEADINGS and tag not in INLINE:
            header = LEAD if attributes and _is_lead(attributes) else 1
        self.tag.append(tag)
        self.parent.append(parent)
        self.cut.append(cut)
        self.weight.append(weight)
        self.outweighed.append(outweighed)
        self.in_article.append(self.in_article[parent] or tag in ARTICLE)
        self.in_header.append(header)
        return node

    def _build(self, source: str) -> None:
        stack, last, at = [0], 0, 0
        #: where in the stack the elements of a tag are
        depths: dict[str, list[int]] = {}
        items = self.items

        def pop_to(depth: int) -> None:
            while len(stack) > depth:
                node = stack.pop()
                depths[self.tag[node]].pop()
                if self.tag[node] not in INLINE:
                    items.append((node, None))

        def deepest(tags: frozenset[str] | set[str]) -> int:
            return max((found[-1] for t in tags if (found := depths.get(t))), default=0)

        while m := TOKEN.search(source, at):
            if m.start() > last:
                items.append((stack[-1], source[last : m.start()]))
            last = at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if found := depths.get(tag):
                    pop_to(found[-1])
                continue
            if tag in ("html", "body") and depths.get(tag):
                continue
            if depths.get("p") and tag in ENDS_P and (depth := depths["p"][-1]) > deepest({"td", "th", "table", "button", "caption"}):
                pop_to(depth)
            if tag in ENDS and (depth := deepest(ENDS[tag][0])) > deepest(ENDS[tag][1]):
                pop_to(depth)
            if tag == "br":
                items.append((stack[-1], " "))
                continue
            node = self._add(stack[-1], tag, m[3])
            if tag not in INLINE:
                items.append((node, None))
            if tag in VOID:
                continue
            if tag in RAW:
                end = RAW[tag].search(source, at)
                last = at = end.start() if end else len(source)
            if tag in depths:
                depths[tag].append(len(stack))
            else:
                depths[tag] = [len(stack)]
            stack.append(node)
        if last < len(source):
            items.append((stack[-1], source[last:]))
        pop_to(1)


def _settle_cuts(page: Page) -> list[bool]:
    """Which nodes are cut, by their tags or because they are hidden."""
    return list(page.cut)


def _blocks(page: Page) -> tuple[list[bool], list[int]]:
    """Which nodes are in links, and the block that each one's text belongs to."""
    n = len(page.tag)
    link, block = [False] * n, [0] * n
    for node in range(1, n):
        up = page.parent[node]
        link[node] = link[up] or page.tag[node] == "a"
        block[node] = block[up] if page.tag[node] in INLINE else node
    return link, block


def weights(page: Page, cut: list[bool], texts: list[tuple[int, str | None]]) -> list[float]:
    """What a character of each node counts."""
    n = len(page.tag)
    link, block = _blocks(page)
    own, said = [0] * n, [""] * n
    for node, text in texts:
        if text and not cut[node]:
            size = len(text) - text.count(" ")
            if not link[node]:
                own[node] += size
            at = block[node]
            if len(said[at]) <= NOTICE_CHARACTERS:
                said[at] += text[: NOTICE_CHARACTERS + 1]
    direct = list(own)
    for node in range(n - 1, 0, -1):
        own[page.parent[node]] += own[node]
    weight = [1.0] * n
    for node in range(1, n):
        here = page.weight[node]
        if page.outweighed[node]:
            share = own[node] / max(1, own[0])
            here += (1 - here) * max(0.0, 2 * share - 1)
        if said[node] and page.tag[node] not in FLOW and len(said[node]) <= NOTICE_CHARACTERS and NOTICE.match(said[node]):
            here = min(here, WEIGHTS["notice"])
        weight[node] = min(weight[page.parent[node]], here)
    weighed = [d * w for d, w in zip(direct, weight, strict=True)]
    if 2 * sum(w for w, within in zip(weighed, page.in_article, strict=True) if within) > sum(weighed):
        weight = [w if within else min(w, WEIGHTS["outside"]) for w, within in zip(weight, page.in_article, strict=True)]
    top = max((weight[node] for node, text in texts if text and text.strip() and not cut[node]), default=1.0)
    return [min(1.0, w / top) for w in weight]


def _density(c: int, t: int, lc: int, lt: int, base: float) -> float:
    """Composite text density; denominators of 0 count as 1, and so do tags."""
    if not c:
        return 0.0
    t = t or 1
    root = math.log(c / max(1, c - lc) * lc + base * c + math.e)
    return max(0.0, c / t * math.log(c / (lc or 1) * t / (lt or 1) + 1) / max(root, 1.0))


class Measures:
    """Densities of all nodes that are not cut, and the sums of their children's."""

    def __init__(self, page: Page, cut: list[bool], texts: list[tuple[int, str | None]], weight: list[float] | None = None):
        n = len(page.tag)
        chars, tags, link_chars, link_tags = [0.0] * n, [0] * n, [0.0] * n, [0] * n
        link, block = _blocks(page)
        self.weight = weight or [1.0] * n
        for node, text in texts:
            if text and not cut[node]:
                size = len("".join(text.split())) * self.weight[node]
                chars[node] += size
                link_chars[node] += size if link[node] else 0
        for node in range(n - 1, 0, -1):
            if not cut[node]:
                up = page.parent[node]
                chars[up] += chars[node]
                link_chars[up] += link_chars[node]
                tags[up] += tags[node] + 1
                link_tags[up] += link_tags[node] + link[node]
        base = link_chars[0] / max(1, chars[0])
        self.of = block
        self.block = [not cut[i] and block[i] == i for i in range(n)]
        self.density = [_density(chars[i], tags[i], link_chars[i], link_tags[i], base) if self.block[i] else 0.0 for i in range(n)]
        self.sums = [0.0] * n
        self.children: list[list[int]] = [[] for _ in range(n)]
        for node in range(1, n):
            if block[node] == node:
                up = block[page.parent[node]]
                self.children[up].append(node)
                self.sums[up] += self.density[node]
        #: characters outside of links, and whether most are
        self.own = [c - lc for c, lc in zip(chars, link_chars, strict=True)]
        self.texty = [2 * o > c for o, c in zip(self.own, chars, strict=True)]


def core_of(page: Page, m: Measures) -> int:
    """The container with the largest sum of its children's densities, or what within it holds nearly all of its text (of marked articles: most)."""
    container = lambda i: m.block[i] and page.tag[i] not in FLOW
    best = max((i for i in range(len(page.tag)) if container(i)), key=lambda i: (m.sums[i] * (2 if page.tag[i] in ARTICLE else 1), -i))
    while inner := next((i for i in m.children[best] if container(i) and m.own[i] >= NEARLY_ALL * m.own[best] > 0), None):
        best = inner
    within = [i == best for i in range(len(page.tag))]
    for node in range(best + 1, len(page.tag)):
        within[node] = within[page.parent[node]]
    return max((i for i in range(len(page.tag)) if within[i] and m.block[i] and page.tag[i] in ARTICLE and 2 * m.own[i] > m.own[best]), default=best)


def threshold_of(page: Page, m: Measures, core: int) -> float:
    """The density from which blocks beside the core's path to the body count as text of the article."""
    least, node = math.inf, core
    while node >= 0:
        least = min(least, m.density[node] or math.inf)
        node = page.parent[node]
    parts = sorted(d for i in m.children[core] if (d := m.density[i]) > 0) or [m.density[core]]
    paragraph = _density(PARAGRAPH, 0, 0, 0, 0.0)
    return min(max(least if least < math.inf else 0.0, parts[len(parts) // 2]), paragraph) * 2 / 3


def _kept(page: Page, m: Measures, children: list[int], inner: int | None, limit: float, weight: float, running: bool) -> list[int]:
    """Which of a node's children belong to the article.

    ``inner`` is the one through which the path to the core goes; ``running`` says that the
    node is the core or as dense, so that its running text belongs to it. ``weight`` is that of the core.
    """
    flow = [page.tag[i] in FLOW and page.tag[i] not in HEADINGS for i in children]
    plain = [m.weight[i] >= weight and m.texty[i] for i in children]
    running = running or any(f and m.density[i] >= limit for i, f in zip(children, flow, strict=True) if i != inner)
    kept = [False] * len(children)
    for at, i in enumerate(children):
        if not m.block[i]:
            continue
        if page.in_header[i]:
            kept[at] = m.density[i] * page.in_header[i] >= HEADER * _density(PARAGRAPH, 0, 0, 0, 0.0)
        elif page.tag[i] not in HEADINGS:
            kept[at] = i == inner or m.density[i] >= limit or running and flow[at] and plain[at]
    # short blocks of text between what is kept
    if running and any(kept):
        first, last = kept.index(True), len(kept) - 1 - kept[::-1].index(True)
        for at in range(first + 1, last):
            i = children[at]
            kept[at] = kept[at] or m.block[i] and plain[at] and not m.children[i] and page.tag[i] not in HEADINGS and not page.in_header[i]
    for at in range(len(children) - 1, -1, -1):
        if page.tag[children[at]] in HEADINGS and m.block[children[at]]:
            titled = page.tag[page.parent[children[at]]] == "header" and page.in_article[page.parent[children[at]]]
            kept[at] = titled and plain[at] or (kept[at + 1] if at + 1 < len(children) else inner is None and running and plain[at])
    return [i for i, keep in zip(children, kept, strict=True) if keep and i != inner]


def chosen(page: Page, m: Measures) -> list[bool]:
    """Whether the text right in each node belongs to the main text."""
    n = len(page.tag)
    core = core_of(page, m)
    limit, weight = threshold_of(page, m, core), m.weight[core]
    beside: dict[int, list[int]] = {}
    node = core
    while node > 0 and page.tag[node] != "body":
        up = m.of[page.parent[node]]
        beside[up] = _kept(page, m, m.children[up], node, limit, weight, False)
        if page.tag[core] in ARTICLE and node == core:
            # the article goes on in others beside it
            beside[up] += [i for i in m.children[up] if i != core and page.tag[i] in ARTICLE and m.block[i] and m.weight[i] >= weight and m.texty[i]]
        node = up
    inside, whole, opened = [False] * n, [False] * n, [False] * n
    #: containers that are judged child by child: the core and what is dense, and what is not, but may hold what is
    dense = {core}
    inside[core] = opened[core] = True
    for node in range(n):
        up = m.of[page.parent[node]] if node else 0
        if m.of[node] != node:
            inside[node] = inside[page.parent[node]]
        elif m.block[node]:
            if whole[up] and (m.weight[node] >= m.weight[up] or m.density[node] >= limit):
                inside[node] = whole[node] = True
            if node in beside:
                found = beside[node]
                for i in m.children[node]:
                    opened[i] = opened[i] or m.block[i] and page.tag[i] == "header" and page.in_article[node]
            elif opened[node]:
                # below the threshold, but a container of running text within the core
                running = node in dense or page.tag[core] not in ("html", "body") and m.texty[node] and m.weight[node] >= weight
                found = _kept(page, m, m.children[node], None, limit, weight, running)
                for i in m.children[node]:
                    opened[i] = m.block[i] and page.tag[i] not in FLOW
            else:
                continue
            for i in found:
                inside[i] = True
                if page.tag[i] in FLOW or page.in_header[i]:
                    whole[i] = True
                else:
                    opened[i] = True
                    dense.add(i)
    return inside


def main_text(source: str | None) -> str:
    """Blocks of the main text in page order, joined by empty lines."""
    if not source:
        return ""
    page = Page(source)
    cut = _settle_cuts(page)
    texts = [(n, t if t is None else htmllib.unescape(t) if "&" in t else t) for n, t in page.items if not cut[n]]
    inside = chosen(page, Measures(page, cut, texts, weights(page, cut, texts)))
    blocks, parts = [], []
    for node, text in [*texts, (0, None)]:
        if text is None:
            if parts:
                if block := " ".join("".join(parts).split()):
                    blocks.append(block)
                parts = []
        elif inside[node]:
            parts.append(text)
    return "\n\n".join(blocks)


FOUND = "page_id long, url string, text string, n_chars long"
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, urls, pages in rows_of(batches, "page_id", "url", "html"):
        texts = [main_text(p) for p in pages]
        yield batch_of([(i, u, t, len(t)) for i, u, t in zip(ids, urls, texts, strict=True)], _ARROW)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: ``page_id, url, text, n_chars``. One pass, no shuffle."""
    small_batches(pages.sparkSession)
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(_extract, FOUND)
