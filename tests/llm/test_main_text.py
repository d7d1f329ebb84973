"""Main text by density: the measure against its definition on a plain tree, and pages whose names mislead."""

from __future__ import annotations

import math
import random
from html.parser import HTMLParser

import pytest

from sentria.llm import main_text
from tests.llm.test_operators import PAGES, PART, STORY, P

LINKS = "<div>" + "".join(f"<a href=/{w}>{w}</a> " for w in ("Home", "World", "Sports", "Money", "Weather", "More")) + "</div>"
REPLIES = "<div>" + "".join(f"<div><div>Reader {i}</div><div>So true {i}</div></div>" for i in range(4)) + "</div>"


class Tree(HTMLParser):
    """A plain tree of well-formed pages: [tag, children, texts]."""

    def __init__(self, source):
        super().__init__()
        self.root = ["html", [], []]
        self.open = [self.root]
        self.feed(source)

    def handle_starttag(self, tag, attrs):
        node = [tag, [], []]
        self.open[-1][1].append(node)
        self.open.append(node)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][2].append(data)


def counts(node, linked=False):
    """Characters, tags, characters in links, link tags below a node, by definition."""
    linked = linked or node[0] == "a"
    c = sum(len("".join(t.split())) for t in node[2])
    out = [c, 0, c if linked else 0, 0]
    for child in node[1]:
        below = counts(child, linked)
        out = [a + b for a, b in zip(out, below, strict=True)]
        out[1] += 1
        out[3] += linked or child[0] == "a"
    return out


def plain_densities(root):
    body = counts(root)

    def density(node):
        c, t, lc, lt = counts(node)
        if not c or node[0] in main_text.INLINE:
            return 0.0
        base = math.log(c * lc / max(1, c - lc) + body[2] / max(1, body[0]) * c + math.e)
        return max(0.0, c / (t or 1) * math.log(c / (lc or 1) * (t or 1) / (lt or 1) + 1) / max(1.0, base))

    out = []

    def walk(node):
        children = [c for c in node[1] if c[0] not in main_text.INLINE]
        out.append((node[0], density(node), sum(density(c) for c in children)))
        for child in node[1]:
            walk(child)

    walk(root)
    return out


def random_page(rnd, depth=0):
    tag = rnd.choice(["div", "p", "section", "article", "ul", "a", "b"] if depth else ["body"])
    inner = "".join(random_page(rnd, depth + 1) if rnd.random() < 0.6 else f"{'word' * rnd.randint(0, 9)} " for _ in range(rnd.randint(0, 5))) if depth < 5 else "deep"
    if tag in ("p", "a", "b"):  # a paragraph would end before a block, and a link before a link
        inner = "some text " * rnd.randint(0, 6)
    return f"<{tag}>{inner}</{tag}>"


@pytest.mark.parametrize("seed", range(60))
def test_densities_by_definition(seed):
    source = random_page(random.Random(seed))
    page = main_text.Page(source)
    cut = main_text._settle_cuts(page)
    m = main_text.Measures(page, cut, [i for i in page.items if not cut[i[0]]])
    plain = plain_densities(Tree(source).root)
    assert [t for t, _, _ in plain] == page.tag and not any(cut)
    for i, (tag, density, total) in enumerate(plain):
        assert math.isclose(m.density[i], density, abs_tol=1e-9), (source, i)
        if tag not in main_text.INLINE:
            assert math.isclose(m.sums[i], total, abs_tol=1e-9)
    scored = [(s * (2 if t in main_text.ARTICLE else 1), i) for i, (t, _, s) in enumerate(plain) if t not in main_text.FLOW | main_text.INLINE]
    best = max(scored, key=lambda x: (x[0], -x[1]))[1]
    core = main_text.core_of(page, m)
    while core > best:
        core = page.parent[core]
    assert core == best


@pytest.mark.parametrize(("html", "kept", "gone"), [
    ("<div class='content search-page'><p>The only text there is.</p></div><p>Next.</p>", ["The only text there is."], []),
    (f"<article class='post has-sidebar comments-open'>{P}</article><p>other</p>", STORY, ["other"]),
    (f"<article>{P}<div class='social-science'><p>On the social sciences.</p></div></article>", [*STORY, "On the social sciences."], []),
    (f"<main><article>{P}</article><article>{PART}</article></main>", [*STORY, "line 0 of it", "line 5 of it"], []),
    (f"<article><header><h1>Title</h1><div><p>A lead that says in a few words what the whole story is about.</p></div><p>by me</p></header>{P}</article>", ["Title", "A lead that says", *STORY], ["by me"]),
    (f"{LINKS}<div>{P}</div>{REPLIES}<div>Copyright 2020 Somebody, all rights reserved</div>", STORY, ["Home", "So true", "Copyright"]),
    (f"<div><div>{LINKS}</div><div><div><h1>Title of it</h1></div><h2>Head</h2><div>{P}</div></div><div>{REPLIES}</div></div>", ["Head", *STORY], ["Home", "So true"]),
    (f"<form id=page>{LINKS}<div>{P}</div></form>", STORY, ["Home"]),
    (f"<div><div>{P}</div><div>{PART}</div></div>{LINKS}", [*STORY, "line 5 of it"], ["Home"]),
    (f"<div>{P}<p>Of.</p><blockquote>{PART * 4}</blockquote><p>No.</p></div>{LINKS}", [*STORY, "Of.", "No.", "line 5 of it"], ["Home"]),
    (f"<div class=ad>{'An advert that is longer than the page. ' * 3}</div><article><p>Short.</p></article>", ["Short."], ["advert"]),
    (f"<div class='comment-list'>{PART}</div><div>{P}</div><div id=siteFooter>All rights</div><ul role=navigation><li>x</ul>", STORY, ["line 0", "All rights", "x\n"]),
    (f"<h1>Head</h1>{P}<p>Of.</p>{LINKS}<ul><li><a href=x>One</a><li><a href=y>Two</a></ul><div>Copyright 2020 Somebody</div>Last words.", ["Head", *STORY, "Of.", "Last words."], ["Home", "One", "Copyright"]),
    (f"<table><tr><td>{LINKS}</td><td><h2>Head</h2>{P}</td></tr></table>", ["Head", *STORY], ["Home"]),
    (f"<div class=page><div class=c-newsletter__form><p>{'Subscribe to all of this. ' * 9}</p></div><div class=article-body>{P}<div class=ad-slot>{'Buy it now. ' * 9}</div></div><div class=related-articles>{PART}</div><div id=cookie-law-info-bar>We use them</div></div>", STORY, ["Subscribe", "Buy", "line 0", "We use"]),
    (f"<div class='post post--with-sidebar article__body'>{P}</div><div class=site-nav__item>Go</div>", STORY, ["Go"]),
    (f"<div id=page><header id=masthead><p>Site</p></header><main><article class='post type-post'><header class=entry-header><h1>Title</h1><div class=entry-meta>By me, May 2024</div></header><div class=entry-content>{P}<div class=sharedaddy><div class='share-buttons'>Share it</div></div></div><footer>Tags</footer></article>"
     f"<div id=comments class=comments-area><ol class=comment-list><li class=comment><article class=comment-body>{PART}</article></ol></div></main><aside class=widget-area>W</aside></div>", ["Title", *STORY], ["Site", "By me", "Share it", "Tags", "line 0", "W\n"]),
    (f"<div>{'Line of a text without paragraphs, which goes on.<br>' * 9}</div><div>Copyright 2020 Somebody</div>", ["goes on. Line"], ["Copyright"]),
])
def test_names_and_threshold(html, kept, gone):
    found = main_text.main_text(f"<body>{html}</body>")
    assert [s for s in kept if s not in found] == [] and [s for s in gone if s in found] == []


def test_density_decides(monkeypatch):
    html = f"<body><div>{'<div>Short line</div>' * 40}</div><div>{P}</div></body>"
    found = main_text.main_text(html)
    assert STORY[0] in found and "Short line" not in found
    monkeypatch.setattr(main_text, "_density", lambda c, t, lc, lt, base: float(c > 0))
    assert main_text.main_text(html) != found


OTHER = "".join(f"<p>The other block says something of its own in line {i}.</p>" for i in range(2))


@pytest.mark.parametrize(("html", "kept", "gone"), [
    (f"<div class='post-content widget'>{P}</div><div>{OTHER}</div>", STORY, []),
    (f"<article>{P}<div>Share this: <span>fb</span> <span>tw</span></div><ul><li><a href=a>tag one</a><li><a href=b>tag two</a></ul><div>Copyright 2024 All rights reserved</div></article>", STORY, ["Share this", "tag one", "Copyright"]),
    (f"<article><div>{P}</div><div class=tools>Share this: fb tw</div><div><a href=a>tag one</a> <a href=b>tag two</a></div><footer>All rights</footer></article>", STORY, ["Share this", "tag one", "All rights"]),
    (f"<article><header><h1>T</h1><p class=lead>Short lead here.</p></header>{P}</article>", ["T", "Short lead here.", *STORY], []),
    ("<ul><li><a href=/>Home page</a><li><a href=/n>News of today</a></ul><div><p>Hi there.</p></div>", ["Hi there."], ["Home page", "News of"]),
    (f"<article>{P}<p>All rights reserved.</p><p>Es be.</p></article><div>Copyright 2024</div>", [*STORY, "All rights reserved.", "Es be."], ["Copyright"]),
    ("<div class=ad>An advert that is a good deal longer than the story.</div><article><h1>A title</h1><p>Es be.</p></article>", ["A title", "Es be."], ["advert"]),
])
def test_names_and_sizes_only_weigh(html, kept, gone):
    found = main_text.main_text(f"<body>{html}</body>")
    assert [s for s in kept if s not in found] == [] and [s for s in gone if s in found] == []


def test_density_decides_on_given_pages(monkeypatch):
    import glob

    import pyarrow.parquet as pq

    from tests.oracle import SF

    pages = [h for f in glob.glob(f"{SF}/pages.parquet") for h in pq.read_table(f)["html"].to_pylist()]
    found = [main_text.main_text(h) for h in pages]
    monkeypatch.setattr(main_text, "_density", lambda c, t, lc, lt, base: float(c > 0))
    assert sum(main_text.main_text(h) != f for h, f in zip(pages, found, strict=True)) > len(pages) // 2


BROKEN = {
    "unclosed tags": "<a ", "brackets": "<", "open quotes": '<a x="', "one open quote": "<b ", "mixed quotes": "<a '\"", "paragraph under a button": "<div>", "page headers": "<header>",
    "items": "<li>", "comments": "<!--", "end tags": "</i></div>", "lists": "<ul><li>", "names": "<p class=ad>", "declarations": "<!", "references": "&amp", "scripts": "<script>", "table": "<table><tr><td>",
}


@pytest.mark.parametrize("name", BROKEN)
def test_work_is_linear_in_broken_pages(name):
    """Four times the page takes some four times the time; a quadratic tokenizer takes sixteen times."""
    import time

    before = {"one open quote": '<a x="', "paragraph under a button": "<p><button>", "end tags": "<b>" * 20_000}.get(name, "")

    def seconds(size):
        page = before + BROKEN[name] * (size // len(BROKEN[name]))
        began = time.process_time()
        main_text.main_text(page)
        return time.process_time() - began

    small, large = min(seconds(100_000) for _ in range(2)), seconds(400_000)
    assert large < 8 * small + 0.5, f"{small:.2f} s, then {large:.2f} s"


class Marked(HTMLParser):
    """A plain tree of well-formed pages with attributes: [tag, children and texts in order, attributes, parent]."""

    def __init__(self, source):
        super().__init__()
        self.root = ["html", [], "", None]
        self.at = self.root
        self.feed(source)

    def handle_starttag(self, tag, attrs):
        node = [tag, [], " ".join(f'{k}="{v}"' for k, v in attrs), self.at]
        self.at[1].append(node)
        self.at = node

    def handle_endtag(self, tag):
        self.at = self.at[3]

    def handle_data(self, data):
        self.at[1].append(data)


def plain_main_text(source):
    """The whole measure on a plain tree, by recursion: pages of div, section, article, p, ul, a, b and headings with names that outweigh nothing."""
    root = Marked(source).root
    kids = lambda n: [c for c in n[1] if isinstance(c, list)]
    every = lambda n: [n, *(x for c in kids(n) for x in every(c))]
    text_of = lambda n: "".join(c if isinstance(c, str) else text_of(c) for c in n[1])
    size = lambda t: len("".join(t.split()))
    within = lambda n, tags: n is not None and (n[0] in tags or within(n[3], tags))
    against = lambda n: main_text.named(" " + n[2]) & (main_text.OTHERS if n[0] in main_text.ARTICLE else main_text.CERTAIN)
    sure = lambda n: n is not None and (bool(against(n)) or sure(n[3]))
    linked = lambda n: within(n, {"a"})
    own_of = lambda n, ok: sum((size(c) if ok(n) else 0) if isinstance(c, str) else own_of(c, ok) for c in n[1])
    all_own, certain = own_of(root, lambda n: not linked(n)), own_of(root, lambda n: not linked(n) and sure(n))
    in_articles = own_of(root, lambda n: not linked(n) and within(n, main_text.ARTICLE) and not sure(n)) + 0.01 * own_of(root, lambda n: not linked(n) and within(n, main_text.ARTICLE) and sure(n))
    outside = 2 * in_articles > all_own - 0.99 * certain
    weight = lambda n: min(0.01 if sure(n) else 1.0, 0.2 if outside and not within(n, main_text.ARTICLE) else 1.0)
    top = max((weight(n) for n in every(root) if any(isinstance(c, str) and c.strip() for c in n[1])), default=1.0)
    w = lambda n: min(1.0, weight(n) / top)
    chars = lambda n, link=False: sum(size(c) * w(n) * (not link or linked(n)) if isinstance(c, str) else chars(c, link) for c in n[1])
    base = chars(root, True) / max(1, chars(root))
    is_block = lambda n: n[0] not in main_text.INLINE
    density = lambda n: main_text._density(chars(n), len(every(n)) - 1, chars(n, True), sum(map(linked, every(n)[1:])), base)
    blocks = lambda n: [b for c in kids(n) for b in ([c] if is_block(c) else blocks(c))]
    total = lambda n: sum(map(density, blocks(n))) * (2 if n[0] in main_text.ARTICLE else 1)
    own = lambda n: chars(n) - chars(n, True)
    texty = lambda n: 2 * own(n) > chars(n)
    box = lambda n: is_block(n) and n[0] not in main_text.FLOW
    core = max(filter(box, every(root)), key=total)
    while inner := [c for c in blocks(core) if box(c) and own(c) >= 0.8 * own(core) > 0]:
        core = inner[0]
    core = ([n for n in every(core) if n[0] in main_text.ARTICLE and 2 * own(n) > own(core)] or [core])[-1]
    path = [core]
    while path[-1][3] is not None:
        path.append(path[-1][3])
    parts = sorted(d for c in blocks(core) if (d := density(c)) > 0) or [density(core)]
    limit = min(max(min((density(n) for n in path if density(n)), default=0.0), parts[len(parts) // 2]), main_text._density(200, 0, 0, 0, 0.0)) * 2 / 3
    heading = lambda n: n[0] in main_text.HEADINGS
    plain = lambda n: w(n) >= w(core) and texty(n)

    def judged(children, inner, running):
        running = running or any(n[0] in main_text.FLOW and not heading(n) and density(n) >= limit for n in children if n is not inner)
        keep = [not heading(n) and (n is inner or density(n) >= limit or running and n[0] in main_text.FLOW and plain(n)) for n in children]
        kept_at = [i for i, k in enumerate(keep) if k]
        for i, n in enumerate(children):
            if running and kept_at and kept_at[0] < i < kept_at[-1] and plain(n) and not blocks(n) and not heading(n):
                keep[i] = True
        for i in reversed(range(len(children))):
            if heading(children[i]):
                keep[i] = keep[i + 1] if i + 1 < len(children) else inner is None and running and plain(children[i])
        return [n for n, k in zip(children, keep, strict=True) if k and n is not inner]

    inside = set()

    def take(n):
        inside.add(id(n))
        for c in blocks(n):
            if w(c) >= w(n) or density(c) >= limit:
                take(c)

    def open_(n, dense):
        running = dense or core[0] not in ("html", "body") and texty(n) and w(n) >= w(core)
        found = judged(blocks(n), None, running)
        for c in blocks(n):
            mine = any(c is f for f in found)
            if mine and c[0] in main_text.FLOW:
                take(c)
            elif c[0] not in main_text.FLOW:
                if mine:
                    inside.add(id(c))
                open_(c, mine)

    inside.add(id(core))
    open_(core, True)
    for n, up in zip(path, path[1:], strict=False):
        if n[0] == "body":
            break
        found = judged(blocks(up), n, False)
        if n is core and core[0] in main_text.ARTICLE:
            found += [c for c in blocks(up) if c is not core and c[0] in main_text.ARTICLE and w(c) >= w(core) and texty(c)]
        for c in found:
            if c[0] in main_text.FLOW:
                take(c)
            else:
                inside.add(id(c))
                open_(c, True)
    out, line = [], []

    def edge():
        if words := "".join(line).split():
            out.append(" ".join(words))
        line.clear()

    def walk(n, block):
        block = n if is_block(n) else block
        if is_block(n):
            edge()
        for c in n[1]:
            if isinstance(c, list):
                walk(c, block)
            elif id(block) in inside:
                line.append(c)
        if is_block(n):
            edge()

    walk(root, root)
    edge()
    return "\n\n".join(out)


def named_page(rnd, depth=0):
    tag = rnd.choice(["div", "div", "p", "section", "article", "ul", "h2"]) if depth else "body"
    name = rnd.choice([""] * 7 + [" class=comments", " id=ad"]) if depth else ""
    words = lambda: " ".join(rnd.choice(["alpha", "be", "gamma,", "<a href=x>link to</a>", "<b>bold</b>"]) for _ in range(rnd.randint(0, 14)))
    if tag in ("p", "h2") or depth >= 5:
        return f"<{tag}{name}>{words()}</{tag}>"
    if tag == "ul":
        return f"<ul{name}>" + "".join(f"<li>{words()}</li>" for _ in range(rnd.randint(0, 4))) + "</ul>"
    return f"<{tag}{name}>" + "".join(named_page(rnd, depth + 1) if rnd.random() < 0.8 else words() for _ in range(rnd.randint(0, 5))) + f"</{tag}>"


@pytest.mark.parametrize("seed", range(250))
def test_whole_pages_by_definition(seed):
    source = named_page(random.Random(seed))
    assert main_text.main_text(source) == plain_main_text(source), source


@pytest.mark.parametrize(("name", "words"), [("cookie-notice", {"notice"}), ("comment-list", {"comment"}), ("commentList", {"comment"}), ("ad_1", {"ad"}), ("has-sidebar", set()), ("comments-open", set()), ("social-science", set()), ("header", set()), ("c-newsletter__form", {"newsletter"}), ("post--with-sidebar", set()), ("site-nav__item", {"nav"}), ("related-articles", {"related"}), ("share", {"share"}), ("", set())])
def test_named(name, words):
    assert main_text.named(f" class='{name}'") == words == main_text.named(f' data-x=1 id="{name}"')


def test_extraction_of_odd_rows(spark):
    rows = [(1, "u", None), (1, None, "<p>a</p>"), (None, "v", ""), (2, "u", f"<article>{P}</article>"), (2, "u", f"<article>{P}</article>"), (3, "w", "x" * 300_000)]
    pages = spark.createDataFrame(rows, PAGES).withColumnRenamed("url", "url").selectExpr("*", "1 as text", "2 as n_chars")
    got = sorted(main_text.extract_main_text(pages).collect(), key=str)
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == sorted([(1, 0), (1, 1), (0, 0), (2, len("\n\n".join(STORY))), (2, len("\n\n".join(STORY))), (3, 300_000)])
    assert all(len(r["text"]) == r["n_chars"] for r in got)
    assert main_text.extract_main_text(pages.limit(0)).count() == 0
