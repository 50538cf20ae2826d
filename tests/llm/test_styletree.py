import math
import random
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest

from rillflow.llm import registry
from rillflow.llm import styletree as S


def text(page):
    return S.extract(page)


def test_names_are_read_whole():
    assert text('<div class="content has-sidebar"><p>Hello main story text</p></div>') == "Hello main story text"
    assert text('<div class="post no-comments"><p>x</p></div>') == "x"
    assert text('<div id="social-science">x</div>') == "x" and text('<div class="top-story">x</div>') == "x"
    assert text('<p>a</p><div class="Post_Comments">b</div><div id="left-sidebar">c</div><div class="x cookie-notice">d</div>') == "a"
    assert text('<div class="site-header">Site</div><p>a</p>') == "a" and text('<main><div class="page-header">Title</div><p>a</p></main>') == "Title\na"
    assert text('<div class="sidebar">all there is</div>') == "all there is"


def test_articles_and_main():
    assert text('<main><h1>H</h1><p>Lead</p><article class="card">teaser</article><p>long body of the page</p></main>') == "H\nLead\nteaser\nlong body of the page"
    assert text("<p>m</p><article>one</article><article>two is longer</article>") == "one\ntwo is longer"
    assert text("<main><p>Crumbs</p><article>The whole long story</article></main><p>x</p>") == "The whole long story"
    assert text('<article>Story</article><article class="comment">A much longer comment than that</article>') == "Story"


def test_attributes_with_quotes():
    assert text("<p data-x=it's>Hello</p><img alt=it's><p>World</p>") == "Hello\nWorld"
    assert text("""<p title="a>b" data-y='<p>'>t</p><div class='ad'>x</div><div id = "comments">y</div>""") == "t"


def test_article_without_its_surroundings():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><aside>Side</aside>
    <div class="cookie-notice">Accept</div><article><header><h1>Title &amp; more</h1></header><p><b>Fat &eacute; text.<br>next<p>Second
    para&nbsp;graph &copy; <i>x</i>y</p><form><input><p>Name</p></form><ul><li>one<li>two</ul><div class="ad">No</div>
    <section id="comments"><p>First!</p></section><table><tr><td>c1<td>c2</table><pre>a
     b</pre><noscript>js</noscript></article><footer>&copy; me</footer></body></html>"""
    assert text(page) == "Title & more\nFat é text. next\nSecond para graph © xy\none\ntwo\nc1\nc2\na b"


def test_broken_and_empty_pages():
    assert text(None) == "" and text("") == "" and text("<") == "<" and text("plain &lt;b&gt;") == "plain <b>"
    assert text("<p>a<p>b</div></p>c") == "a\nb\nc"
    assert text("<article><p>x</article><p>y") == "x"
    assert text("<p>before<!-- never closed <p>after") == "before"
    assert text("<body><p>a</p><script>no end <p>b") == "a"
    assert text("<div hidden>h</div><div style='display: none'>n</div><p title='a>b'>t</p>") == "t"
    assert text("<p>" * 3000 + "deep") == "deep" and text("<div>" * 5000 + "deep") == "deep"
    assert text("<a" * 20_000 + "x") != ""
    assert text("x " * 300_000) == ("x " * 300_000).strip()


def pages(spark, n=40):
    rows = []
    for i in range(n):
        body = f"<div class='top'><p>Welcome to our site</p><p>Call us now</p></div><div class='c'><h2>Story {i}</h2><p>Unique words {i * i} here for story number {i} of the lot.</p><p>Shared line.</p></div><div class='bottom'><p>All about us</p></div>"
        rows.append((i, f"https://Host.example/{i}?q=1", f"<html><body>{body}</body></html>", "old"))
    return rows


def test_repeated_branches_of_a_host_go(spark):
    rows = pages(spark) + [(100, "http://other.example/x", "<body><p>Welcome to our site</p><p>alone</p></body>", "old"), (101, None, None, "old"), (102, "no url", "", "old")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = {r.page_id: r for r in S.extract_pages(df, "url", "html").collect()}
    assert len(got) == len(rows) and got[0].__fields__ == ["page_id", "url", "html", "text", "n_chars"]
    for i in range(40):
        assert got[i].text.startswith(f"Story {i}\nUnique words") and "Welcome" not in got[i].text and "about us" not in got[i].text
    assert got[100].text == "Welcome to our site\nalone" and got[101].text == "" and got[102].n_chars == 0


def test_articles_that_many_pages_repeat_stay_whole(spark):
    same = "<body><nav><a>m</a></nav><article><h1>Same</h1><p>The same story.</p></article></body>"
    rows = [(i, "http://h.example/", same) for i in range(30)] + [(i, "http://g.example/", "<body><p>The same story.</p></body>") for i in range(30, 60)]
    got = S.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), "url", "html").collect()
    assert {(r.page_id < 30, r.text) for r in got} == {(True, "Same\nThe same story."), (False, "The same story.")}
    assert S.extract_pages(spark.createDataFrame([], "page_id long, url string, html string"), "url", "html").count() == 0


def test_copied_articles_keep_lists_tables_and_sections(spark):
    def page(story, extra=""):
        return f"<body><article><h1>{story}</h1><p>{f'All about {story} at length. ' * 9}</p>{extra}<div class='tail'><p>Read more on our site</p></div></article></body>"

    own = "<ul><li>a<li>b</ul><ol><li>c</ol><table><tr><td>d<td>e</table><section><p>f</p></section><dl><dt>g<dd>h</dl><div><p>i</p></div>"
    rows = []
    for host, copies, n in (("x", 3, 5), ("y", 4, 10), ("z", 64, 1000)):
        for i in range(n):
            rows.append((len(rows), f"http://{host}.example/{i}", page("copy", own) if i < copies else page(f"story {host}{i}")))
    got = S.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), "url", "html").collect()
    body = lambda t: f"{t}\n{('All about ' + t + ' at length. ') * 9}".strip()
    for r in got:
        copy = "about copy at" in r.html
        assert not copy or r.text == body("copy") + "\n" + "\n".join("abcdefghi")
        assert "Read more" not in r.text


def random_pages(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        parts = [f"<div class='{rng.choice(['a', 'b'])}{rng.randrange(3)}'>" + "".join(rng.choice(["<p>one</p>", "<p>two</p>", f"<p>own {i}</p>", "<ul><li>x<li>y</ul>", "<div class='w-1/2'><p>z</p></div>"]) for _ in range(rng.randrange(4))) + "</div>" for _ in range(rng.randrange(4))]
        if rng.random() < 0.5:
            parts.append(f"<article><h1>{rng.choice(['s', 't', str(i)])}</h1><div class='more'><p>read on</p></div></article>")
        out.append((i, f"http://h{rng.randrange(3)}.example/{i}", "<body>" + "".join(parts) + "</body>"))
    return out


def by_hand(rows):
    """Importance by key, straight from the definition: page by page, in dictionaries."""
    seen = {k: defaultdict(lambda: defaultdict(set)) for k in range(3)}
    for i, url, page in rows:
        for kind, node, value, story in S.page_counts(url.split("/")[2], page):
            seen[kind][node][value].add(story if story is not None else (i,))
    out = {}
    for node, values in seen[S.TEXTS].items():
        m = len(seen[S.PAGES][node][0]) + S.SPARSE
        out |= {v: (None, x) for v, pages in values.items() if len(pages) > 1 and (x := 1 - math.log(len(pages)) / math.log(m)) < S.COMMON}
    for node, values in seen[S.LOOKS].items():
        if len(values) > 1:
            n = [len(p) for p in values.values()]
            entropy = -sum(k / sum(n) * math.log(k / sum(n)) for k in n)
            out[node] = (S.GAMMA ** len(n), min(1.0, entropy / math.log(len(seen[S.PAGES][node][0]) + S.SPARSE)))
    return out


def test_tree_against_counting_by_hand(spark):
    rows = random_pages(150, 5)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    counts = S.style_counts(df.select(S.host(df["url"]).alias("host"), "html"))
    got = {r.key: (r.weight, r.importance) for r in S.importance(counts).collect()}
    want = by_hand(rows)
    assert set(got) == set(want) and len(got) > 20
    for k, (w, x) in want.items():
        assert got[k][0] == (pytest.approx(w) if w is not None else None) and got[k][1] == pytest.approx(x)


def test_what_a_page_counts():
    rows = S.page_counts("h", "<body><div><p>a</p><p>a</p><p>b</p></div></body>")
    assert Counter(r[0] for r in rows) == {S.TEXTS: 2, S.LOOKS: 3, S.PAGES: 4} and {r[3] for r in rows} == {None}
    with_story = S.page_counts("h", "<body><p>x</p><article><p>a</p></article></body>")
    assert len({r[3] for r in with_story}) == 1 and None not in {r[3] for r in with_story}


def test_a_tree_too_large_to_broadcast_is_joined(spark, monkeypatch):
    rows = random_pages(120, 6) + [(500, None, None), (501, "x", ""), (502, "http://h0.example/same", "<p>one</p>"), (502, "http://h0.example/same", "<p>one</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    plain = sorted((r.page_id, r.text, r.n_chars) for r in S.extract_pages(df, "url", "html").collect())
    monkeypatch.setattr(S, "BROADCAST_KEYS", 0)
    assert sorted((r.page_id, r.text, r.n_chars) for r in S.extract_pages(df, "url", "html").collect()) == plain
    assert len(plain) == len(rows) and any(t != S.extract(x) for (_, t, _), (_, _, x) in zip(plain, sorted(rows, key=lambda r: (r[0], r[2] or "")), strict=True))


def test_few_pages_say_little():
    importance = lambda k, m: 1 - math.log(k) / math.log(m + S.SPARSE)
    assert importance(2, 2) > S.THRESHOLD and importance(3, 3) > S.THRESHOLD and importance(5, 5) < S.THRESHOLD and importance(100, 100) < 0.02


class Plain(HTMLParser):
    """Blocks of the article by the standard library's parser: enough for the given pages, which mark all else by tag or class."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = 0, [[]]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag == "br":
            self.blocks[-1].append(" ")
        elif tag in ("p", "h1", "article"):
            self.blocks.append([])

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append([])

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1].append(data)


def test_whole_query_against_another_parser(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/pages.parquet").collect()
    want = {}
    for r in rows:
        p = Plain()
        p.feed(r.html or "")
        p.close()
        want[r.page_id] = "\n".join(t for t in (" ".join("".join(b).split()) for b in p.blocks) if t)
    got = registry.op10_site_style(spark, folder).collect()
    assert len(got) == len(rows) and sum(r.text != want[r.page_id] for r in got) == 0
    assert all(r.n_chars == len(r.text) for r in got)
