"""Layout wrappers whose names hold a word of noise keep their article; parts that are noise still go."""

import math
import random
import time

import pytest

from terragrist.llm import html_text

TEXT = "<p>" + "The whole article stays, word by word. " * 12 + "</p><p>" + "It has a second part as well. " * 9 + "</p>"
NAMES = ["page has-sidebar", "with-header", "no-comments", "content search-result", "main legal", "post share-enabled", "sidebar"]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("inner", ["div", "article", "main"])
def test_wrappers_keep_their_article(name, inner):
    page = f"<html><body><div class='menu'><a href='/'>Start</a></div><div class='{name}'><{inner}>{TEXT}</{inner}></div><div class='comment-list'>Nice one</div></body></html>"
    got = html_text.main_text(page)
    assert got.count("word by word.") == 12 and got.count("second part") == 9
    assert "Start" not in got and "Nice one" not in got


def test_a_form_around_the_page_is_no_form():
    assert html_text.main_text(f"<body><form id='aspnetForm'><div>{TEXT}</div></form></body>").count("second part") == 9


def test_long_comments_do_not_replace_a_marked_article():
    comments = "".join(f"<article class='comment-body'><p>{'I think so too. ' * 9}</p></article>" for _ in range(9))
    got = html_text.main_text(f"<body><article>{TEXT}</article><div id='comments' class='comments-area'>{comments}</div></body>")
    assert got.count("second part") == 9 and "I think" not in got


def _article(inside):
    return f"<html><body><nav><a href='/'>Start</a></nav><div id='content'><p>{'Some words of the article. ' * 12}</p>{inside}<p>{'And more of them at the end. ' * 12}</p></div></body></html>"


@pytest.mark.parametrize(
    "inside, want",
    [
        ("<p>aaa bbb<br>ccc<br/>ddd</p>", "aaa bbb ccc ddd"),
        ("<p>before <span class='header'>within</span> after</p>", "before within after"),
        ("<table><tr><th class='table-header'>head</th></tr><tr><td class='banner'>cell</td></tr></table>", "head\ncell"),
        ("<p class='share-price'>A price went up</p>", "A price went up"),
        ("<section class='legal-history'><p>History of law</p></section>", "History of law"),
        ("<p>one <label>two</label> three</p>", "one two three"),
        ("<p>if a<b and c holds</p>", "if a<b and c holds"),
        ("<p>x <a title='1 > 2' href=\"/?a>b\">link</a> y</p>", "x link y"),
        ("<p>say \"a <b>bold\" word</b></p>", "say \"a bold\" word"),
        ("<script>if (a<b) x = \"<p>\" + '</p'</script><p>after the script</p>", "after the script"),
        ("<p>un<!-- not > here -->seen</p>", "unseen"),
    ],
)
def test_text_inside_an_article_stays(inside, want):
    lines = html_text.main_text(_article(inside)).split("\n")
    assert "\n".join(lines[1:-1]) == want and lines[0].startswith("Some words") and lines[-1].endswith("at the end.")


@pytest.mark.parametrize("tail", ["<a", "<a ", "<a \"", "<a '<b", "<a \"<a\" ", "<!x", "<?", "<script>", "<script></script", "<b><p></p>", "<b></i>", "<i></b><p>", "&", "<a b=\"'", "</", "<li><dt>", "<div>"])
def test_long_odd_pages_take_linear_time(tail):
    began = time.time()
    got = html_text.main_text("<body><p>" + "Words of an article. " * 20 + "</p>" + "<b>" * 4000 + tail * ((1_000_000 if tail == "<a" else 250_000) // len(tail)))
    assert got.startswith("Words of an article.") and time.time() - began < 20


def _plain_densities(tree, share, linked=False):
    """Densities and sums of (tag, children or text) trees, by recursion; `share`: of the page's text in links."""
    tag, inner = tree
    chars = links = tags = link_tags = 0
    total, all_ = 0.0, []

    def walk(node, in_link):
        nonlocal chars, links, tags, link_tags
        for x in node[1]:
            if isinstance(x, str):
                chars += len(x)
                links += len(x) * in_link
            else:
                tags += 1
                link_tags += x[0] == "a"
                walk(x, in_link or x[0] == "a")

    linked = linked or tag == "a"
    walk(tree, linked)
    for x in inner:
        if not isinstance(x, str):
            d, rest = _plain_densities(x, share, linked)
            total += d
            all_ += rest
    t, lt = max(1, tags), max(1, link_tags)
    d = 0.0
    if chars:
        d = chars / t * math.log(chars / max(1, links) * t / lt + 1) / math.log(math.log(chars / max(1, chars - links) * links + share * chars + math.e) + math.e)
    return d, [(d, total), *all_]


def test_densities_equal_a_plain_version():
    rng = random.Random(8)

    def tree(depth, in_link=False):
        tag = rng.choice(["div", "section", "i", "b", "div"] + ["a"] * (not in_link))
        inner = []
        for _ in range(rng.randrange(4) if depth else 0):
            inner.append(tree(depth - 1, in_link or tag == "a") if rng.random() < 0.6 else "word " * rng.randrange(1, 9))
        return tag, inner or ["x"]

    show = lambda t: f"<{t[0]}>{''.join(x if isinstance(x, str) else show(x) for x in t[1])}</{t[0]}>"
    for _ in range(60):
        body = ("body", [("div", [tree(4), tree(3)]), "tail"])
        text = lambda t, a: [z for y in t[1] for z in ([(y, a)] if isinstance(y, str) else text(y, a or y[0] == "a"))]
        pieces = text(body, False)
        share = sum(len(x) for x, a in pieces if a) / sum(len(x) for x, _ in pieces)
        page = html_text.parse(show(body))
        got = list(zip(*html_text._densities(page)))[1:]
        want = _plain_densities(body, share)[1]
        assert page.tag[1] == "body" and len(got) == len(want)
        assert all(abs(g[0] - w[0]) < 1e-9 and abs(g[1] - w[1]) < 1e-6 for g, w in zip(got, want))


def test_odd_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", "<p>one</p>", "x", 5), (1, "u", "<p>one</p>", "x", 5), (None, None, None, None, None), (2, None, "<p>" + "long words " * 300_000 + "</p>", None, 1)]
    df = spark.createDataFrame(rows, schema)
    got = sorted(((r[0], r[3]) for r in html_text.extract(df).collect()), key=str)
    assert got == sorted([(1, 3), (1, 3), (None, 0), (2, 11 * 300_000 - 1)], key=str)
    assert html_text.extract(df.limit(0)).collect() == []
