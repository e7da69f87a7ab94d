import pytest
from tests.llm.samples import SF, frame

from tarmac.llm import site_style as s

PAGES = "page_id bigint, url string, html string"


def text(page):
    return "\n\n".join(b.text for b in s.kept_blocks(*s.parse(page)))


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>a <b>b</b>&amp;&nbsp;c\n\n d<p>e<br>f", "a b& c d\n\ne f"),
        ("<html><head><title>t</title><style>p{}</style></head><body><script>var t='</p>';</script><article><h1>T</h1><p>x &copy; &#x41;&am</p></article><footer>f</footer>", "T\n\nx © A&am"),
        ("<nav><ul><li><a href=/>m</a></ul></nav><main><p>x</p><form><input><p>q</p></form><aside>s</aside></main>", "x"),
        ("<header><h1>Site</h1></header><article><header><h1>T</h1></header><p>x</p><section id=comments><article class=comment><p>c</p></article></section></article>", "T\n\nx"),
        ("<div class='page has-sidebar'><div class=sidebar>s</div><article><p>x</p></article></div>", "x"),
        ("<div id=cookie-notice><p>n</p></div><div class=content><p>x</p><p>y</p></div><div class='comment-list'><p>c</p></div>", "x\n\ny"),
        ("<div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><p>x <a href=4>y</a></p>", "x y"),
        ("<article><p>x</p><div class=adBox>ad</div><ul><li>i<li>j</ul><table><tr><td>1<td>2</table><pre> a\n  b</pre></article>", "x\n\ni\n\nj\n\n1\n\n2\n\na b"),
        ("<!-- <p>no</p> --><p title='a > b'>1 < 2</p><!-- open <p>z", "1 < 2"),
        ("<article><p hidden>h</p><p style='display:none'>h</p><p>x</p></article>", "x"),
        ("<article><p>The longer story</article></div></section><p>tail", "The longer story"),
        ("", ""), ("plain", "plain"), ("<<<>>", "<<<>>"), ("<p", "<p"),
    ],
)
def test_one_page(page, want):
    assert text(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<script>for(i=0;i<n;i++)s+=i</script><p>Body</p>", "Body"),
        ("<style>a{}<!-- b{}</style><p>Body</p>", "Body"),
        ("<script>x='<!--'</SCRIPT ><p>Body</p>", "Body"),
        ("<script>'</scripts>'</script><p>Body</p><script>open", "Body"),
        ("<div>" * 1500 + "deep", "deep"),
    ],
)
def test_text_after_raw_elements_and_deep_pages(page, want):
    assert text(page) == want


@pytest.mark.parametrize(
    "page",
    [
        "<body class='single comments-open'><p>The story</p></body>",
        "<article class='post has-comments'><p>The story</p></article>",
        "<div id='discussion-page'><article><p>The story</p></article></div>",
        "<form id='aspnetForm'><div class=menu>m</div><p>The story</p></form>",
        "<div class='layout no-sidebar'><p>The story</p><div class=comments>c</div></div>",
        "<div class='wrapper ad-free'><p>The story</p></div>",
        "<div class='search-page'><p>The story</p></div><footer>f</footer>",
        "<div class='widget-main'><p>The story</p></div>",
        "<article><p>The story</p><article class=comment>c</article></article>",
    ],
)
def test_named_branches_that_hold_the_story_stay(page):
    assert text(page) == "The story"


@pytest.mark.parametrize(
    "page, want",
    [
        ("<div class=story><p>The story stands here, not in the teaser.</p></div><article class=teaser><p>Read this</p></article>", "The story stands here, not in the teaser."),
        ("<div class=story><p>The story stands here, not beside it.</p></div><article><p>Short</p></article>", "The story stands here, not beside it.\n\nShort"),
        ("<article><p>One</p><div class='notice-period'><p>Two</p></div></article>", "One\n\nTwo"),
        ("<p>One</p><div class='research-search-notes'><p>Two</p></div>", "One\n\nTwo"),
        ("<div title=it's><p>x</p></div><p data-a='b>c' title=\"d>'e\">y</p>", "x\n\ny"),
        ("<div><p>The story begins.</p><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul><p>And goes on.</p></div>", "The story begins.\n\none\n\ntwo\n\nthree\n\nAnd goes on."),
        ("<ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul><div><p>The story.</p></div>", "The story."),
        ("<article><p>The story of the day.</p></article><section id=comments><p>" + "I say so. " * 50 + "</p></section>", "The story of the day."),
    ],
)
def test_names_and_lists_alone_sink_nothing_important(page, want):
    assert text(page) == want


def plain_tree(pages):
    """(host, node): (pages, importance) of style trees held in memory."""
    import math
    from collections import Counter, defaultdict

    shapes, leaves = defaultdict(dict), defaultdict(lambda: defaultdict(set))
    for _, url, page in pages:
        host = (url or "").split("://")[-1].split("/")[0].lower()
        root, blocks = s.parse(page or "")
        article = "\n".join(b.text for b in s.kept_blocks(root, blocks))
        todo = list(root.children)
        while todo:
            node = todo.pop()
            todo += node.children
            shapes[host, node.path].setdefault(tuple(dict.fromkeys(x.label for x in node.children)), set()).add(article)
            for b in node.blocks:
                for what in ([("t", s._DIGITS.sub("0", b.text))] if b.text else []) + [("a", s._DIGITS.sub("0", x)) for x in b.links]:
                    for x in s._above(node):
                        leaves[host, x.path][node.path, what].add(article)
    out = {}
    for key, shape in shapes.items():
        if key not in leaves:
            continue
        n = sum(len(x) for x in shape.values())
        counts = Counter(len(x) for x in shape.values())
        presentation = max(0.0, -sum(k * c / n * math.log(c / n) for c, k in counts.items()) / math.log(n)) if n > 1 else 1.0
        spread = [len(x) for x in leaves[key].values()]
        content = max(0.0, 1 - sum(k * math.log(k) for k in spread) / (sum(spread) * math.log(n))) if n > 1 else 1.0
        share = s.GAMMA ** sum(1 for x in shape if x)
        out[key] = (n, (1 - share) * presentation + share * content)
    return out


def test_tree_equals_one_in_memory(spark):
    """Importance of every node, and the texts that follow, on given pages and pages of one layout without names."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    for k in range(30):
        menu = "".join(f"<li><a href=/{x}>{x}</a>" for x in ("home", "news", "about"))
        rows.append((5000 + k, "http://layout.example/p", f"<div class=q1><ul>{menu}</ul></div><div class=q2><p>Story {chr(97 + k % 26) * (k + 3)}</p>{'<p>more</p>' * (k % 4)}</div><div class=q3><p>Kept by us {k}</p></div>"))
    want = plain_tree(rows)
    got = {(r.host, r.node): (r.pages, r.importance) for r in s.node_importance(frame(spark, rows, PAGES)).collect()}
    assert set(got) == set(want)
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    texts = {r.page_id: r.text for r in s.main_text(frame(spark, rows, PAGES)).collect()}
    changed = 0
    for page_id, url, page in rows:
        host = (url or "").split("://")[-1].split("/")[0].lower()
        judged = {node: x for (h, node), (n, x) in want.items() if h == host and n >= s.PAGES}
        own = "\n\n".join(b.text for b in s.kept_blocks(*s.parse(page), judged)) if page else ""
        assert texts[page_id] == own
        changed += own != text(page or "")
    assert changed >= 30 and texts[5003] == "Story " + "d" * 6 + "\n\nmore" * 3


def test_clashing_columns(spark):
    names = ["host", "judged", "node", "text", "n_chars", "kind"]
    rows = [(1, "http://h/a", "<p>x", *names), (1, "http://h/a", "<p>x", *names)]
    assert [r.text for r in s.main_text(frame(spark, rows, PAGES + "".join(f", `{x}` string" for x in names))).collect()] == ["x", "x"]


def test_repeated_branches_of_a_host_go(spark):
    """Blocks without telling names, the same on every page of a host, are learnt as noise."""
    pages = []
    for k in range(12):
        body = f"<div class=x1><p>Welcome to the site, visit {k}</p></div><div class=x2><p>Story {k} of its own, with word{chr(97 + k)}</p><p>more {chr(97 + k) * 5}</p></div><div class=x3><p>All rights kept</p></div>"
        pages.append((k, "http://one.example.com/p", body))
        pages.append((100 + k, f"http://host{k}.example.org/p", body))
    out = {r.page_id: r.text for r in s.main_text(frame(spark, pages, PAGES)).collect()}
    for k in range(12):
        own = f"Story {k} of its own, with word{chr(97 + k)}\n\nmore {chr(97 + k) * 5}"
        assert out[k] == own
        assert out[100 + k] == f"Welcome to the site, visit {k}\n\n{own}\n\nAll rights kept"  # nothing to compare with


def test_copies_keep_their_article(spark):
    page = "<div class=a><p>The same story on every page, long enough to be the most of it.</p></div><div class=b><p>{}</p></div>"
    rows = [(k, "https://WWW.copies.example.com:80/x", page.format("z")) for k in range(30)]
    rows += [(100 + k, "https://www.copies.example.com/x", page.format("near copy " + chr(97 + k) * 3)) for k in range(20)]
    out = {r.page_id: r.text for r in s.main_text(frame(spark, rows, PAGES)).collect()}
    assert out[0].startswith("The same story") and out[105] == "The same story on every page, long enough to be the most of it.\n\nnear copy fff"


def test_importance_is_entropy(spark):
    rows = [(k, "http://h/", f"<nav><p>menu</p></nav><div><p>{chr(97 + k) * 4}</p></div>") for k in range(8)]
    got = sorted((round(r.importance, 6), r.pages) for r in s.node_importance(frame(spark, rows, PAGES)).collect())
    assert got[:2] == [(0.0, 8), (0.0, 8)] and got[-1] == (1.0, 8)


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "x", ""), (None, "http://h/a", "<p>a"), (3, "http://h/a", "<p>é"), (3, "http://h/a", "<p>é"), (4, "http://h/a", "<p>" + "long " * 50_000)]
    out = sorted((tuple(r) for r in s.main_text(frame(spark, rows, PAGES)).collect()), key=str)
    assert [(i, n) for i, _, _, n in out] == [(1, 0), (2, 0), (3, 1), (3, 1), (4, 249_999), (None, 1)]
    assert s.main_text(frame(spark, [], PAGES)).collect() == []


def test_pages_give_their_article(spark):
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in s.main_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", r.html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:h1|p)>", article)]
        assert got[r.page_id] == "\n\n".join(x for x in parts if x)
