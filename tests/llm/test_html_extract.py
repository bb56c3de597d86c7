import html
import re

import pytest

from lexicarta.llm.html_extract import extracted, main_text
from lexicarta.llm.queries import op6_html_extract

BODY = "<p>First, a paragraph with some words, and commas.</p><p>Second one, &amp; longer than the first, as it goes on.</p>"
TEXT = "First, a paragraph with some words, and commas.\nSecond one, & longer than the first, as it goes on."


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<html><body><nav><ul><li><a href=x>Home</a><li>Menu, with, many, commas</ul></nav><article><h1>Title</h1>{BODY}</article></body></html>", "Title\n" + TEXT),
        (f"<div id=wrapper><div class='sidebar'><p>Side, text, that, is, long, enough, to, win.</p></div><div class=post-body>{BODY}</div><div class='comments'><p>I, think, so, too, and, more, and, more.</p></div></div>", TEXT),
        (f"<body><header><p>Head, a, b</p></header><main>{BODY}</main><footer><p>&copy; all, rights</p></footer>", TEXT),
        (f"<body><div class='cookie-consent'>We use cookies, as all do, sorry.</div><div>{BODY}</div><form><p>Name, mail</p></form></body>", TEXT),
        (f"<script>var a = '<p>no, no</p>';</script><style>p{{}}</style><!-- <p>no</p> --><div>{BODY}</div>", TEXT),
        ("<article><p><b>Bold start.<br><p>Next  para\n graph &lt;tag&gt; &#233;.</article>", "Bold start.\nNext para graph <tag> é."),
        (f"<article><section>{BODY}</section><section><p>Third part, apart from the others, in words.</p></section></article>", TEXT + "\nThird part, apart from the others, in words."),
        (f"<main><article>{BODY}</article><section class=comments><article><p>A, comment, with, commas, of, some, length</p></article></section></main>", TEXT),
        (f"<table><tr><td class=menu><a href=x>a</a><td>{BODY}</table>", TEXT),
        ("<article><ul><li>one, item<li>two</ul><div>loose, text here</div></article>", "one, item\ntwo\nloose, text here"),
        (f"<div hidden><p>Not, shown, at, all, never, ever.</p></div><div style='display: none'><p>Nor, this.</p></div><div>{BODY}</div>", TEXT),
        (f"<div>{BODY}", TEXT),
        (f"<div class='page has-sidebar'><div class=sidebar><p>Side, text, a, b, c.</p></div><article>{BODY}</article></div>", TEXT),
        (f"<div class='layout with-menu'><h1>Head</h1>{BODY}</div><div class=menu>a</div>", "Head\n" + TEXT),
        (f"<div class=comments><article>{BODY}</article></div><div><p>The text, really, is here.</p></div>", "The text, really, is here."),
        ("just, plain text", "just, plain text"),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("<p>unfinished <b", "unfinished"),
        ("</p></div></article><p>stray, ends.</p>", "stray, ends."),
        ("<article><p>a < b, and c > d &am x</p></article>", "a < b, and c > d &am x"),
        (f'<div><p title="the hidden truth">First, a paragraph with some words, and commas.</p>{BODY[BODY.index("<p>Second"):]}</div>', TEXT),
        (f'<article data-tags="nice hidden gems">{BODY}</article>', TEXT),
        (f"<div data-x='a hidden b' hidden><p>Not, shown.</p></div><article>{BODY}</article>", TEXT),
        ('<article><p class="x"">A stray quote, here.</p><p>And "more", too.</p></article>', 'A stray quote, here.\nAnd "more", too.'),
        ('<article><p title="a > b">One, two.</p><p title=\'it"s\'>Three.</p><p a=b"c>Four.</p></article>', "One, two.\nThree.\nFour."),
        (f"<!--><article>{BODY}</article><!-- x --><!--->", TEXT),
        ("<body><div><p>One, two.</p></div><div><p>Three, four.</p></div></body>", "One, two.\nThree, four."),
        ("<article><p>The, start, of, it.</p><p class=notice>A, notice, of, the, text.</p><p>Go <em class=search>on</em>.</p></article>", "The, start, of, it.\nA, notice, of, the, text.\nGo on."),
        (f"<article>{BODY}<p class='advert'>Buy, now.</p><div class=notice>We, tell, you.</div></article>", TEXT),
        ("<body><div class='search'><p>All, there, is.</p></div></body>", "All, there, is."),
        ("<body><div class='comments'><p>Only, a, comment.</p></div></body>", ""),
        (f"<article><header><h1>Title</h1></header>{BODY}</article>", "Title\n" + TEXT),
        (f"<article><header><h1>Title</h1><p>By, me</p></header>{BODY}</article>", TEXT),
        (f"<header><h1>Site</h1></header><article>{BODY}</article>", TEXT),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "<p>Deep, down.</p>" + "</div>" * 3000
    assert main_text(deep) == "Deep, down."
    long = "<article>" + "<p>word, word word.</p>" * 20_000 + "</article>"
    assert main_text(long).count("\n") == 19_999
    assert main_text("<" * 5000 + "<p>x, y</p>").endswith("x, y")


def test_given_pages_lose_no_block_of_the_article(spark, folder):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = op6_html_extract(spark, folder).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in re.split(r"</?(?:h1|p)>", article)]
        assert r.text == "\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text)


def test_awkward_rows(spark):
    rows = [(1, None, None), (None, "u", "<p>x, y</p>"), (2, "v", ""), (2, "v", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = extracted(pages).collect()
    assert sorted(map(str, got)) == sorted(map(str, [(1, None, ""), (None, "u", "x, y"), (2, "v", ""), (2, "v", "")])) or sorted(
        (str(r.page_id), str(r.url), r.text) for r in got
    ) == sorted([("1", "None", ""), ("None", "u", "x, y"), ("2", "v", ""), ("2", "v", "")])
    assert extracted(pages.limit(0)).count() == 0


def test_sibling_articles_belong_together():
    def part(name):
        lines = [f"{name} line {i}, a sentence with commas, long enough to count, and to end here." for i in range(5)]
        return lines, "<article>" + "".join(f"<p>{x}</p>" for x in lines) + "</article>"

    (a, first), (b, second) = part("First"), part("Second")
    page = f"<html><body><div>{first}{second}</div><div><a href='x'>other pages</a></div></body></html>"
    assert main_text(page).split("\n") == a + b


def plain_scores(root):
    """Points of every element by plain recursion: each paragraph climbs to all elements around it."""
    from lexicarta.llm import html_extract as H

    def kept(node):
        return [c for c in node.children if isinstance(c, str) or not c.dropped]

    def length(node, in_link=False, links_only=False):
        link = in_link or node.name == "a"
        own = sum(len(" ".join(c.split())) for c in kept(node) if isinstance(c, str) and (link or not links_only))
        return own + sum(length(c, link, links_only) for c in kept(node) if not isinstance(c, str))

    points = {}

    def visit(node):
        loose = node.name not in H.SCORED | H.INLINE and any(isinstance(c, str) and c.strip() for c in kept(node))
        if (node.name in H.SCORED or loose) and node is not root and length(node):
            text = " ".join(" ".join(H.blocks(node)).split())
            worth = 1 + sum(text.count(c) for c in ",、，") + min(len(text) / 100, 10)
            worth *= 1 - length(node, links_only=True) / length(node)
            around, up = [], node if loose else node.parent
            while up is not None:
                around.append(up)
                up = up.parent
            for depth, up in enumerate(around):
                if 0.5**depth > 0.05:
                    points[up] = points.get(up, 0.0) + worth * 0.5**depth
        for c in kept(node):
            if not isinstance(c, str):
                visit(c)

    visit(root)
    ranks = {}
    for node, found in points.items():
        if node.name not in ("#root", "html", *H.INLINE) and length(node):
            ranks[node] = (found + node.bonus) * (1 - length(node, links_only=True) / length(node))
    return ranks


@pytest.mark.parametrize("seed", range(40))
def test_scores_are_those_of_a_plain_version(seed):
    import random

    from lexicarta.llm import html_extract as H

    rng = random.Random(seed)

    def tree(depth):
        made = []
        for _ in range(rng.randint(1, 4)):
            name = rng.choice(["div", "div", "section", "p", "ul", "a", "em", "td", "article", "blockquote", "nav"])
            kind = rng.choice(["", "", " class=content", " class=sidebar", " id=x"])
            words = " ".join(rng.choice(["word", "a,", "longer,", "b"]) for _ in range(rng.randint(0, 40)))
            inner = tree(depth - 1) if depth and name not in ("p", "em", "a") else ""
            made.append(f"<{name}{kind}>{words}{inner}</{name}>")
        return "".join(made)

    page = f"<body>{tree(4)}</body>"
    root = H.parse(page)
    chosen = H.article(root)
    ranks = plain_scores(root)
    for node, rank in ranks.items():
        own = (node.points + node.bonus) * (1 - node.link_chars / node.chars)
        assert own == pytest.approx(rank)
    if ranks and chosen[0].name not in ("article", "main", "body"):
        best = max(ranks.values())
        assert any(ranks.get(n, -1) == pytest.approx(best) or n.bonus >= 30 for n in chosen)
    assert not re.search(r"</?(?:div|p|section|em|a)\b", main_text(page))
