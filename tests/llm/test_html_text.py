import math
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.llm import html_text as H
from graphloom.sources import table

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=x>menu</a></ul></nav><!-- c --><div class=\"ad\">buy</div>"
    "<article><h1>A &amp; B</h1><p><b>One&nbsp;two<br>three<p>Four &lt;5 <div class='comments'><p>me too</p></div></article><footer>&copy; f</footer>"
)


def texts(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r for r in H.extract_text(pages).collect()}


def test_article(spark):
    found = texts(spark, [(1, "https://h.example.com/a", PAGE), (2, None, None), (3, "x", ""), (4, "http://h.example.com", "<p>a <b>b")])
    assert found[1].text == "A & B\n\nOne two three\n\nFour <5" and found[1].n_chars == len(found[1].text)
    assert (found[2].text, found[3].text, found[3].n_chars, found[4].text) == ("", "", 0, "a b")


def test_the_style_tree_removes_what_a_site_repeats(spark):
    page = lambda i: f"<body><div class=top><p>Site name</p></div><div class=story><p>Story {i} begins</p><p>and ends {i * 7}</p></div><div class=bottom><p>All rights</p></div></body>"
    rows = [(i, f"http://s.example.com/{i}", page(i)) for i in range(8)] + [(100, "http://other.example.com/", page(100))]
    found = texts(spark, rows)
    assert all(found[i].text == f"Story {i} begins\n\nand ends {i * 7}" for i in range(8))
    assert found[100].text == "Site name\n\nStory 100 begins\n\nand ends 700\n\nAll rights"  # a single page tells nothing


def test_repeated_articles_stay(spark):
    found = texts(spark, [(i, "http://h.example.com/x", PAGE) for i in range(6)])
    assert {r.text for r in found.values()} == {"A & B\n\nOne two three\n\nFour <5"}


def test_long_pages_and_empty_table(spark):
    long = "<article>" + "<p>word " * 50_000 + "</article>"
    assert texts(spark, [(1, "u", long)])[1].n_chars == 50_000 * 6 - 2
    assert texts(spark, []) == {}


def test_runs_of_markup():
    for page in ("<" * 100_000, "<div>" * 100_000 + "x", "</p>" * 100_000, "<a '" * 50_000, "<script>" * 50_000, "<!--" * 50_000, "<p>" * 100_000 + "x", "&" * 100_000, "<li>" * 50_000):
        H.parse(page)


def test_copies_of_a_page_keep_their_text(spark):
    copy = "<body><div class=story><p>All of it</p></div></body>"
    rows = [(i, f"http://h.example.com/{i}", copy) for i in range(5)]
    other = [(10 + i, f"http://h.example.com/o{i}", f"<body><div class=story><p>Other {i}</p></div></body>") for i in range(4)]
    found = texts(spark, rows + other)
    assert {found[i].text for i in range(5)} == {"All of it"} and found[12].text == "Other 2"
    assert {r.text for r in texts(spark, rows).values()} == {"All of it"}


def test_deep_branches_are_judged_apart(spark):
    page = lambda i: f"<body><div class=wrap><div class=row><div class=col><span><div class=offer><p>Buy now</p></div></span><div class=story><p>Story {i}</p><p>ends {i * 7}</p></div></div></div></div></body>"
    found = texts(spark, [(i, f"http://s.example.com/{i}", page(i)) for i in range(8)])
    assert all(found[i].text == f"Story {i}\n\nends {i * 7}" for i in range(8))


def test_the_tree_judges_pages_with_articles(spark):
    within = lambda i: f"<body><article><div class=hint><p>Read our rules</p></div><p>Story {i} begins</p><p>and ends {i * 7}</p></article></body>"
    teaser = lambda i: f"<body><div class=text><p>A long text number {i} that has many words</p></div><article><p>Teaser {i}</p></article></body>"
    found = texts(spark, [(i, "http://a.example.com/", within(i)) for i in range(6)] + [(10 + i, "http://b.example.com/", teaser(i)) for i in range(6)])
    assert all(found[i].text == f"Story {i} begins\n\nand ends {i * 7}" for i in range(6))
    assert all(found[10 + i].text == f"A long text number {i} that has many words\n\nTeaser {i}" for i in range(6))


def test_words_inside_the_article_are_no_roles(spark):
    page = (
        "<body><article><h1>T</h1><h2 id=login>How to login</h2><p>Use it.</p><h2 id=related>Related work</h2><p>Much.</p><section id=social><p>The social history</p></section>"
        "<div class=comment-free><p>No comment</p></div><p>Let <math><mi>x</mi></math> be.</p><div class='comment-list'><p>First!</p></div><ul class=share><li>Tweet</li></ul></article>"
        "<div id=related><p>More</p></div></body>"
    )
    assert texts(spark, [(1, "http://h/", page)])[1].text == "T\n\nHow to login\n\nUse it.\n\nRelated work\n\nMuch.\n\nThe social history\n\nNo comment\n\nLet x be."


def test_names_of_noise():
    for names in ("ad", "AD-box".lower(), "site-footer", "x cookie_notice", "comments-area"):
        assert H.says_noise(names)
    for names in ("", "comment-free", "article-header", "adder", "main-content", "social-history-of-rome"):
        assert not H.says_noise(names)


def test_repeating_main_content_keeps_its_branches(spark):
    """Pages of one host that are nearly copies."""
    page = lambda i: f"<body><article><p>The same</p><p>on every page</p><p>but {i}</p></article></body>"
    found = texts(spark, [(i, "http://h.example.com/", page(i)) for i in range(9)])
    assert all(found[i].text == f"The same\n\non every page\n\nbut {i}" for i in range(9))


def slow_tree(pages):
    """Importance by path of one host, from pages as nested (tag, children) with texts as strings."""
    seen = defaultdict(Counter)
    blocks = defaultdict(list)
    for body in {repr(p): p for p in pages}.values():
        here = defaultdict(set)

        def walk(node, path, here=here):
            own = path and path[-1]
            tags = [c[0] for c in node[1] if not isinstance(c, str)]
            if own:
                here[path].add(("style", tuple(t for k, t in enumerate(tags) if not k or tags[k - 1] != t)))
            for c in node[1]:
                if isinstance(c, str):
                    for k in range(1, len(path) + 1):
                        here[path[:k]].add(("block", path, c))
                else:
                    walk(c, (*path, c[0]))

        walk(body, ())
        for path, things in here.items():
            for x in things:
                (seen if x[0] == "style" else blocks)[path] += Counter([x]) if x[0] == "style" else [x]
    pages_of = {path: sum(1 for p in {repr(p): p for p in pages}.values() if has(p, path)) for path in seen}
    out = {}
    for path, styles in seen.items():
        total = sum(styles.values())
        entropy = -sum(n / total * math.log(n / total) for n in styles.values()) / math.log(max(2, pages_of[path]))
        places = Counter(blocks[path])
        content = 1 - sum(n * (1 - 1 / n) for n in places.values()) / sum(places.values()) if places else 0.0
        weight = 0.9 ** len(styles)
        out[path] = max(content, (1 - weight) * entropy + weight * content)
    return out


def has(node, path):
    return not path or any(not isinstance(c, str) and c[0] == path[0] and has(c, path[1:]) for c in node[1])


def markup(node):
    return f"<{node[0]}>" + "".join(c if isinstance(c, str) else markup(c) for c in node[1]) + f"</{node[0]}>"


def test_tree_against_brute_force(spark):
    import random

    rng = random.Random(3)

    def node(depth):
        kids = [node(depth - 1) for _ in range(rng.randrange(1, 4))] if depth else []
        return (rng.choice(["div", "section", "ul"]), kids or [f"text {rng.randrange(12)}"])

    pages = [("body", [node(2) for _ in range(rng.randrange(1, 4))]) for _ in range(40)]
    pages += pages[:10]
    df = spark.createDataFrame([(i, "http://h.example.com/", markup(p)) for i, p in enumerate(pages)], "page_id long, url string, html string")
    found = {r.branch: r.importance for r in H.site_style_tree(df).collect()}
    expected = slow_tree(pages)
    assert len(found) == len(expected)
    for path, importance in expected.items():
        key = "h.example.com"
        for tag in path:
            key = H._key(f"{key}/{tag}.")
        assert found[key] == pytest.approx(importance), path


def test_many_branches_give_the_same_texts(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(H.extract_text(pages, few_branches=0)) == rows(H.extract_text(pages))


def test_articles_of_the_table(spark):
    """Brute force by the one markup that the table has: the blocks of the article element."""
    import html

    pages = table(spark, "/root/testdata/sf0.01", "pages")
    found = {r.page_id: r.text for r in H.extract_text(pages).collect()}
    for r in pages.collect():
        body = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert found[r.page_id] == "\n\n".join(b for b in blocks if b)


def test_the_tree_alone_on_large_hosts(spark):
    """Without roles the tree removes menus, adverts and footers where a host has enough pages."""
    pages = table(spark, "/root/testdata/sf0.1", "pages")
    large = pages.groupBy(H.host(F.col("url")).alias("host")).count().filter("count > 250").select("host")
    some = pages.join(large, H.host(F.col("url")) == F.col("host"), "left_semi")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(H.extract_text(some, roles=False)) == rows(H.extract_text(some))


def test_clashing_columns_and_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "http://h/", PAGE), (1, "http://h/", PAGE)], "page_id long, url string, html string")
    pages = pages.withColumns({c: F.lit(7) for c in ("host", "row", "blocks", "removed", "branch", "packed", "data", "text", "n_chars")})
    found = H.extract_text(pages).collect()
    assert len(found) == 2 and {r.text for r in found} == {"A & B\n\nOne two three\n\nFour <5"}


def test_malformed_markup_and_noise_within_lines():
    def text(page):
        return "|".join(b[0] for b in H.parse(page)[0])

    assert text("<article><p title=it's>Hello one</p><p>Second</p></article>") == "Hello one|Second"
    assert text("<article><p data-x='unclosed>Hello one</p><p>it's second</p></article>") == "Hello one|it's second"
    assert text("<p title=\"a > b\" class = 'x y'>One</p><p title='>'>Two</p><p a=\"b\"c>Three") == "One|Two|Three"
    assert text("<p a=\">One</p><p>Two") == "One|Two"
    assert text("<article>Body<article class='comment'>reader</article><article>nested</article></article>") == "Body|nested"
    assert text("<main><p>Body</p><section id='comments'><p>reader</p></section><div id=comments>more</div><div id='notice-1'>kept</div></main>") == "Body|kept"
    assert text("<article><p>One <span class='ad'>buy <b>now</b></span>two <a class=share href=x>send</a><button>go</button> three<span hidden>x</span></p></article>") == "One two three"
    # noise within a line that holds blocks, and that is never closed
    assert text("<article>One <span class='ad'>buy<p>more</p>yet</span> two</article>") == "One|two"
    assert text("<article><p>One <span hidden>x<p>y</article><p>Two") == "One|y|Two"
    assert text("<p><span hidden>x</span></p><p>Two") == "Two"


def test_attributes_take_linear_time():
    began = time.monotonic()
    for page in ("<p " + "a='x " * 200_000, "<p " + "a=\"" * 300_001, "<p a='" * 200_001, "<p " + "=" * 1_000_000 + "\"", "<span hidden>x" * 100_000, "<p a=\"'" * 100_000):
        H.parse(page)
    assert time.monotonic() - began < 30
