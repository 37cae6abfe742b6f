import random
import re
import time
from html.parser import HTMLParser
from itertools import count

import pytest

from spindrel.llm import html_extract as H
from spindrel.llm.html_extract import extract, main_text

ARTICLE = "<p>First part, with commas, and more, long enough to count &amp; be kept.</p><p>Second &eacute; part,\n\n here.</p>"
TEXT = "First part, with commas, and more, long enough to count & be kept. Second é part, here."


@pytest.mark.parametrize("page", [
    f"<html><body><nav><a href=/>Home</a></nav><article>{ARTICLE}</article><footer>Foot, note</footer></body></html>",
    f"<body><div class=menu><ul><li><a href=x>One</a><li><a>Two</a></ul></div><div class='post-content'>{ARTICLE}</div><div id=comments><p>Nice, very, nice, indeed, yes.</p></div>",
    f"<div id=sidebar><p>Side, text, side</p></div><main>{ARTICLE}<form><input>Send, now</form><script>if (a<b) '</p>'</script><style>p{{}}</style></main>",
    f"<div class='cookie-notice'>Cookies, ok?</div><div><div>{ARTICLE}</div></div><div class='ad'>Buy, now</div><aside>x, y</aside>",
    f"<div><!-- <p>no, no</p> -->{ARTICLE.replace('</p>', '')}</div><div hidden>gone, gone</div><div style='display: none'>gone</div>",
    f"<table><tr><td>{ARTICLE}</td></tr></table><div class=links><a href=a>One link, two</a> <a href=b>Three</a></div>",
])
def test_pages(page):
    assert main_text(page) == TEXT


@pytest.mark.parametrize("page", [
    f"<article><p class=share>Share, this{ARTICLE}</article>",
    f"<body><div><ul><li class=nav-item>Home<li class=nav-item>News</ul>{ARTICLE}</div>",
    f"<div><dl><dt class=menu>One<dd class=menu>Two</dl>{ARTICLE}</div>",
    f"<div><table><tr class=ad><td>Buy, now<tr><td class=menu>More</table>{ARTICLE}</div>",
    f"<div><table><tbody><tr><td class=ad>Buy<tbody class=ad><tr><td>now</table>{ARTICLE}</div>",
    f"<div><nav><ul><li>Home<li>News</ul><p>Go<div>deep</nav>{ARTICLE}</div>",
    f"<html><head><meta charset=utf-8><title>T, t</title><body><div>{ARTICLE}</div>",
])
def test_omitted_ends_end_what_is_dropped(page):
    assert main_text(page) == TEXT


@pytest.mark.parametrize("page", [
    f"<article>{ARTICLE}<nav><ul><li><p>a</div><li>b<div/></ul></nav></article>",
    f"<article>{ARTICLE}<table class=ad><tr><td>x</article></div>y<td>z</table></article>",
    f"<article>{ARTICLE}<aside><section><li>a<li>b</section>c</aside></article>",
])
def test_dropped_stays_dropped(page):
    assert main_text(page) == TEXT


def test_inline_markup_joins_and_blocks_part():
    assert main_text("<article><p>a<b>b</b>c<br>d<p>e <i>f</i></article>") == "abc d e f"


@pytest.mark.parametrize("page", [
    None, "", "  ", "<", "<p", "</div></p>", "<!-- x", "<script>x", "<div>" * 5000 + "deep", "<p>" + "<i>" * 5000 + "x", "<a href='x>y", "&#xfffffff; &bogus;", "<b><p></b></p>" * 50,
])
def test_broken_pages_never_fail(page):
    assert isinstance(main_text(page), str)


@pytest.mark.parametrize("page", [
    f"<ul><li class=share>x<li>y</ul><article>{ARTICLE}</article>",
    f"<article><p class=ad>Buy{ARTICLE}</article>",
    f"<div title='the hidden gem'>{ARTICLE}</div>",
    f"<div data-hidden='false' data-class='ad' my-id=comments>{ARTICLE}</div>",
    f"<div class='side-by-side no-sidebar tag-ads'>{ARTICLE}</div>",
    f"<div class='post'>{ARTICLE}</div><div class='comment-content'><p>Nice, very, nice, and, long.</p></div>",
    f"<div class='post'>{ARTICLE}</div><div class='sidebar content'><p>Side, text, of, commas.</p></div>",
    f"<article>{ARTICLE}<article class='comment hentry'><p>Mine, too, I, say.</p></article></article>",
    f"<form id=aspnet><div id=menu><a href=x>y</a></div><div id=content>{ARTICLE}<input></div></form>",
    f"<body class=sidebar-right><div class='layout sidebar-left'><main>{ARTICLE}</main></div></body>",
    f"<div class=cookie-bar><article>{ARTICLE}</article></div>",
    f"<a name=top><div>{ARTICLE}</div>",
    f"<div>{ARTICLE}<ul><li><a href=x>One</a><li><a href=y>Two</a></ul></div>".replace("<ul>", "<ul class=pager>"),
])
def test_marks_are_read_from_names_only(page):
    assert main_text(page) == TEXT


def test_quotes_open_values_only_after_equals():
    assert main_text(f"<div><p title=it's>Hello.{ARTICLE}<p>it's</div>") == f"Hello. {TEXT} it's"
    assert main_text(f"<div><p title='it>Hello.{ARTICLE}</div>") == f"Hello. {TEXT}"
    assert main_text("<article><p class = 'a' id=\"b>c\" hidden-not x/>5 < 6 & a <b>c</article>") == "5 < 6 & a c"


@pytest.mark.parametrize("deep", [0, 1, 3, 9, 30])
def test_nested_sections_are_all_kept(deep):
    part = "<div>" * deep + f"<section>{ARTICLE}</section>" + "</div>" * deep
    assert main_text(f"<body><nav>x, y</nav><div>{part * 3}</div></body>") == " ".join([TEXT] * 3)
    assert main_text(f"<body>{part * 3}<div class=ad>Buy, now</div></body>") == " ".join([TEXT] * 3)


def test_blocks_part_also_around_what_is_dropped():
    assert main_text("<article>a<nav>n</nav>b wor<script>x</script>d<p>c</p>d</article>") == "a b word c d"


@pytest.mark.parametrize("unit", [
    "<a ", "<a b=\"", "<i>", "<i></b>", "<!--", "<div>ab", "<p>", "<b><div><i>", "</b>", "<li><div>", "<table><tr><td>a", "<a href=x><div>a", "</script", "<ul><li>", "</", "<p x='",
])
def test_time_is_linear(unit):
    def took(size):
        began = time.process_time()
        main_text("<b><div>" + "<i>" * (size // 20) + unit * (size // len(unit)))
        return time.process_time() - began

    took(1000)
    assert took(480_000) < 0.2 + 24 * took(60_000)


def by_definition(root):
    """The text of a tree (tag, classes, items) by the rules as stated, each number from its definition."""
    nodes, up = [], {}

    def walk(x):
        nodes.append(x)
        for y in x[2]:
            if not isinstance(y, str):
                up[id(y)] = x
                walk(y)

    walk(root)
    dropped = lambda x: x[0] in ("nav", "aside") or x[1] in ("ad", "comments")
    alive = [x for x in nodes if not any(dropped(y) for y in chain(x, up))]
    texts = lambda x, skip: [t for y in x[2] for t in ([y] if isinstance(y, str) else [] if skip(y) else texts(y, skip))]
    size = lambda x: sum(len(t.strip()) for t in texts(x, dropped))
    links = lambda x: size(x) if x[0] == "a" else sum(links(y) for y in x[2] if not isinstance(y, str) and not dropped(y))
    share = lambda x: links(x) / size(x) if size(x) else 0.0
    own = {id(x): 0.0 for x in alive}
    score = dict(own)
    for x in alive:
        text = " ".join("".join(texts(x, lambda y: dropped(y) or y[0] in ("div", "section", "article", "p", "a"))).split())
        if x[0] in ("b", "a") or len(text) < 2:
            continue
        worth, part = 1 + text.count(",") + min(len(text) / 100, 3), 1.0
        for y in chain(x, up):
            if y[0] != "p" and y[0] not in ("b", "a"):
                own[id(y)] += worth * (part == 1.0)
                score[id(y)] += worth * part
                part /= 2
    marked = lambda x: (score[id(x)] + (30.0 if x[0] == "article" and score[id(x)] else 0.0)) * (1 - share(x))
    holders = [x for x in alive if x[0] in ("div", "section", "article") and size(x)]
    return own, score, marked, holders, share, lambda x: texts(x, dropped)


def chain(x, up):
    while x is not None:
        yield x
        x = up.get(id(x))


def random_tree(rng, number, depth=0):
    """Parts with words that all differ."""
    words = lambda n: " ".join(f"w{next(number)}{rng.choice(['', '', ',', '.'])}" for _ in range(n))
    items = []
    for _ in range(rng.randint(1, 4)):
        if rng.random() < 0.35 or depth > 4:
            inner = [words(rng.randint(1, 30)), ("b", "", [f" {words(1)} "]), ("a", "", [words(3)])][: rng.randint(1, 3)]
            items.append(("p", rng.choice(["", "", "", "ad"]), inner))
        else:
            tag = rng.choice(["div", "div", "section", "nav", "aside"])
            items.append((tag, rng.choice(["", "", "", "ad", "comments"]), random_tree(rng, number, depth + 1)))
    return items


def written(x):
    if isinstance(x, str):
        return x
    return f"<{x[0]}{' class=' + x[1] if x[1] else ''}{' href=x' if x[0] == 'a' else ''}>{''.join(map(written, x[2]))}</{x[0]}>"


@pytest.mark.parametrize("seed", range(80))
def test_scores_and_choice_equal_their_definition(seed):
    rng, number = random.Random(seed), count()
    tag = rng.choice(["div", "article"])
    tree = ("div", "", [*random_tree(rng, number), (tag, "", [*random_tree(rng, number), ("p", "", [f"w{next(number)}, and more."])])])
    page = written(tree)
    root = H.parse(page)
    for x in H.nodes_of(root):  # that a mark may be lifted is not part of this test
        x.items = [] if x.mark else x.items
    own, score, worth, holders, share, texts = by_definition(tree)
    nodes = [x for x in H.measure(root) if x.tag in ("div", "section", "article") and x.text]
    got = sorted((round(x.points, 6), round(x.score, 6), round(H.density(x), 6), round(H.worth(x), 6)) for x in nodes)
    assert got == sorted((round(own[id(x)], 6), round(score[id(x)], 6), round(share(x), 6), round(worth(x), 6)) for x in holders)
    words = [int(w) for w in re.findall(r"w(\d+)", main_text(page))]
    assert words == sorted(set(words))  # in page order
    alive = {int(w) for w in re.findall(r"w(\d+)", " ".join(texts(tree)))}
    assert set(words) <= alive
    best = max(map(worth, holders))
    enough = max(3.0, 0.2 * max(score[id(x)] * (1 - share(x)) for x in holders if worth(x) == best))
    for x in holders:  # the best container and all with enough points of their own are whole
        if worth(x) == best or tag == "div" and own[id(x)] * (1 - share(x)) >= enough and not any(share(y) > 0.75 for y in x[2] if not isinstance(y, str)):
            assert {int(w) for w in re.findall(r"w(\d+)", " ".join(texts(x)))} <= set(words)


def test_siblings_are_kept():
    para = "<p>" + "Words of a part, " * 20 + "</p>"
    assert main_text(f"<div><section>{para}</section><section>{para}</section></div>").count("Words") == 40


def test_long_page():
    body = "".join(f"<p>Part {i}, of a page.</p>" for i in range(20_000))
    text = main_text(f"<article>{body}</article>")
    assert text.startswith("Part 0, of a page. Part 1,") and text.endswith("Part 19999, of a page.")


def test_extract_rows(spark, sf):
    rows = [(1, "u", None, "own", 7), (1, "u", None, "own", 7), (2, None, "<article><p>a &lt; b</article>", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = extract(pages)
    assert got.columns == ["page_id", "url", "html", "text", "n_chars"]
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in got.collect()) == [(1, "", 0), (1, "", 0), (2, "a < b", 5)]
    assert extract(pages.limit(0)).count() == 0
    for r in extract(spark.read.parquet(f"{sf}/pages.parquet")).collect():
        plain = Plain()
        plain.feed(r["html"])
        assert r["text"] == " ".join(" ".join("".join(b).split()) for b in plain.blocks if "".join(b).strip())


class Plain(HTMLParser):
    """The blocks of the article element, by the parser of the standard library."""

    def __init__(self):
        super().__init__()
        self.blocks, self.inside = [[]], 0

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag not in ("a", "b", "i", "em", "strong", "span"):
            self.blocks.append([])

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag not in ("a", "b", "i", "em", "strong", "span"):
            self.blocks.append([])

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1].append(data)
