import json
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from keelson.llm import wrappers as w
from keelson.llm.html_blocks import is_furniture, parse
from keelson.llm.queries import op6_wrapper_extraction


def of(*pages):
    out = None
    for p in pages:
        out = w.infer(p) if out is None else w.combine(out, w.infer(p))
    return out


def test_expressions():
    assert w.expression(of("<div>a</div>")) == "<div>('text')"
    assert w.expression(of("<div>a</div>", "<div>b</div>")) == "<div>(#)"
    assert w.expression(of("<ul><li>a<li>b</ul>", "<ul><li>c</ul>")) == "<ul>(<li>+(#))"
    assert w.expression(of("<h1>t</h1><p>a</p>", "<h1>t</h1><div>n</div><p>b</p>")) == "<h1>('text') <div>?('text') <p>(#)"
    assert w.expression(of("<dl><dt>a<dd>b<dt>c<dd>d</dl>")) == "<dl>((<dt>(#) <dd>(#))+)"
    assert w.expression(of("<p class='x9 a1'>q</p>")) == "<p.a.x>('text')"


def test_order_of_pages_does_not_change_the_rules():
    pages = [f"<div class=top>same</div><div class=b>text {i}</div>" + ("<div class=opt>o</div>" if i % 2 else "") for i in range(6)]
    rng = random.Random(1)
    first = w.rules(of(*pages))
    for _ in range(5):
        rng.shuffle(pages)
        assert w.rules(of(*pages)) == first
    assert first == {"roots": [], "drop": ["div.opt", "div.top"]}
    a, b = of(*pages[:3]), of(*pages[3:])
    assert w.rules(w.combine(json.loads(json.dumps(a)), b)) == first


def test_template_text_without_a_name_is_dropped_if_others_vary():
    page = "<div class=x1><b>Our motto</b></div><div class=y>{}</div>"
    pages = [page.format(f"story {i}") for i in range(4)]
    known = w.rules(of(*pages))
    assert [w.extract(p, known) for p in pages] == [f"story {i}" for i in range(4)]
    same = [page.format("story")] * 4
    assert w.extract(same[0], w.rules(of(*same))) == "Our motto story", "equal pages have no template to tell"


FURNITURE = """<html><head><title>T</title><style>p{}</style><script>var x="<article>no</article>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div id="cookie-notice">We use cookies</div><div class="ad">Buy</div>
@
<aside>Side</aside><form><label>Mail</label><input value=v><button>Go</button></form><section id="comments"><h3>Comments</h3><article class="comment">Nice!</article></section>
<div class="related-posts">More</div><div hidden>secret</div><div style="display: none">ghost</div><footer>&copy; us</footer></body></html>"""
MAIN = "<h1>A&amp;B <i>ti</i>tle</h1><p>One  &lt;x&gt;\n two<br>three<p>four&nbsp;five<ul><li>six<li>seven</ul><table><tr><td>a<td>b</table><!-- gone --><blockquote>q&#8364;</blockquote>"
TEXT = "A&B title One <x> two three four five six seven a b q€"


@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ("<main>", "</main>"), ("<div class='post-content'>", "</div>"), ("<div>", "</div>"), ("<article>", "")])
def test_articles_without_furniture(open_, close):
    page = FURNITURE.replace("@", open_ + MAIN + close)
    if not close:
        page = page.split("<aside>")[0]
    assert w.extract(page, w.rules(of(page))) == TEXT


@pytest.mark.parametrize(
    "names, furniture",
    [
        ("main-nav", True), ("site-footer", True), ("page-header", True), ("ad-top", True), ("sidebar-content", True), ("cookiebar", True), ("shareButtons", True), ("comment-body", True),
        ("post-comments", True), ("menu-item active", True), ("content", False), ("post-content", False), ("has-sidebar", False), ("no-comments", False), ("entry-header", False), ("content with-sidebar", False),
        ("shadow", False), ("reading", False), ("heading", False), ("col-12 row", False), ("", False),
    ],
)
def test_names(names, furniture):
    assert is_furniture("div", {"class": names}) is furniture


def test_article_elements_by_name():
    assert not is_furniture("article", {"class": "post related"})
    assert is_furniture("article", {"class": "comment"})
    assert not is_furniture("body", {"class": "sidebar"})


def test_links_in_the_article_stay_and_link_lists_outside_go():
    page = "<div class=z><ul><li><a href=1>alpha</a><li><a href=2>beta</a></ul></div><div class=k><p>See <a href=3>this</a> and read on, please do.</p></div>"
    assert w.extract(page, w.rules(of(page))) == "See this and read on, please do."


@pytest.mark.parametrize(
    "page, text",
    [(None, ""), ("", ""), ("   ", ""), ("plain", "plain"), ("a < b & c", "a < b & c"), ("<article>x", "x"), ("</p></div>y", "y"), ("<article>cut &am", "cut &am"), ("<p title='a>b'>t", "t"), ("<p x=\"1>t", "t"), ("<script>never closed", ""), ("<article><textarea>no</textarea>yes</article>", "yes"), ("<!-- a -- b --><p>c", "c"), ("<!-- open", "")],
)
def test_odd_pages(page, text):
    assert w.extract(page) == text


def test_deep_and_wide_pages_end():
    deep = "<div>" * 20_000 + "core"
    assert w.extract(deep, w.rules(of(deep, deep))) == "core"
    wide = "".join(f"<x{i % 7}>t</x{i % 7}><y{i % 5}>u</y{i % 5}>" for i in range(3000))
    assert len(w.extract(wide, w.rules(of(wide, wide + "<p>n")))) > 0
    assert parse("<" * 2000).children


def test_long_lists_align_like_short_ones():
    many = [f"x{i}" for i in range(2000)]
    without = [x for i, x in enumerate(many) if i % 10]
    page = lambda tags: "".join(f"<{t}>{t}</{t}>" for t in tags)
    # custom elements nest unless they are closed, so that all are siblings
    shown = w.expression(of(page(many), page(without)))
    assert shown == " ".join(f"<{t}>{'' if int(t[1:]) % 10 else '?'}('text')" for t in many)


def test_groups_of_any_length_repeat():
    row = "".join(f"<div class={c}>{c}</div>" for c in "abcdefg")
    assert w.expression(of(row * 4)) == "(" + " ".join(f"<div.{c}>('text')" for c in "abcdefg") + ")+"


def test_spark_equals_plain_python(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        host = "hot.org" if i % 3 == 0 else f"h{i % 11}.org"
        body = f"<div class=m>Motto of {host}</div><div class=t>Story {i} {'w ' * rng.randrange(40)}</div>" if i % 2 else f"<article><p>Art {i}</article><footer>f"
        rows.append((i, f"http://{host}/{i}", body))
    rows += [(None, None, None), (None, None, None), (500, "nohost", "<p>p</p>"), (501, "http://long.org/", "<p>" + "long " * 60_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("clash"), "text": F.lit(1), "row": F.lit(2), "rules": F.lit("x")}).repartition(5)
    by_host = {}
    for _, url, html in rows:
        host = url.split("://")[1].split("/")[0] if url and "://" in url else ""
        by_host.setdefault(host, []).append(html)
    known = {h: w.rules(of(*pages)) for h, pages in by_host.items()}
    want = sorted(((i, url, w.extract(html, known[url.split("://")[1].split("/")[0] if url and "://" in url else ""])) for i, url, html in rows), key=repr)
    assert sorted(map(tuple, w.main_text(df).collect()), key=repr) == want
    assert w.main_text(df.limit(0)).count() == 0


class Reference(HTMLParser):
    """The article's text by the standard library's parser: written for the test pages alone."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.inside, self.off = [[]], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside += 1
        elif tag in ("script", "style", "nav", "footer"):
            self.off += 1
        if tag not in ("b", "i", "a", "br"):
            self.blocks.append([])

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside -= 1
        elif tag in ("script", "style", "nav", "footer"):
            self.off -= 1
        if tag not in ("b", "i", "a"):
            self.blocks.append([])

    def handle_data(self, data):
        if self.inside > 0 and not self.off:
            self.blocks[-1].append(data)

    @classmethod
    def text_of(cls, page):
        reader = cls()
        reader.feed(page)
        reader.close()
        return " ".join(x for x in (" ".join("".join(b).split()) for b in reader.blocks) if x)


def test_query_equals_an_independent_parser(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in op6_wrapper_extraction(spark, sf_dir).collect()}
    want = {i: Reference.text_of(page) for i, page in pages.items()}
    assert {i: t for i, (t, _) in got.items()} == want
    assert all(n == len(t) for t, n in got.values())
    changed = sum(w.extract(page) != want[i] for i, page in pages.items())
    assert changed > 0.9 * len(pages), "without its host's wrapper a page is all its text"


def test_the_wrapper_finds_the_article_without_a_name_or_kind_to_go_by():
    """Classes say nothing: links and text that never changes are what tells."""
    def page(i):
        links = "".join(f"<li><a href=/{k}>Topic {k} of {i}</a>" for k in range(6))
        return f"<div class=q1><b>The Daily</b></div><div class=q2><ul>{links}</ul></div><div class=q3><h1>Story {i}</h1><p>It begins {i}.<p>It goes on {i * i}, see <a href=/z>there</a>.<div class=q4>Sign up now</div></div><div class=q5>All rights reserved</div>"

    pages = [page(i) for i in range(6)]
    known = w.rules(of(*pages))
    assert [w.extract(p, known) for p in pages] == [f"Story {i} It begins {i}. It goes on {i * i}, see there." for i in range(6)]


def test_constant_text_inside_an_article_goes_and_repeated_paragraphs_stay():
    page = "<article><h1>T{0}</h1><p>Body {0}<p>This license line is on every page.<div class=box>Share this story</div></article>"
    pages = [page.format(i) for i in range(5)]
    known = w.rules(of(*pages))
    assert [w.extract(p, known) for p in pages] == [f"T{i} Body {i} This license line is on every page." for i in range(5)]


def test_roots_by_share_of_text():
    teaser = "<main><h1>T</h1><p>{} the long story is told here<article class=next>Next: more</article></main>"
    pages = [teaser.format(i) for i in range(3)]
    assert w.extract(pages[1], w.rules(of(*pages))).startswith("T 1 the long story")
    inner = "<main><div class=k>{0}</div><article><p>{0} the long story is told here, and at length, until it ends at last</article></main>"
    pages = [inner.format(i) for i in range(3)]
    assert w.extract(pages[1], w.rules(of(*pages))) == "1 the long story is told here, and at length, until it ends at last"


def test_furniture_and_articles_below_the_tree_s_depth():
    deep = "<div>" * 400
    page = f"{deep}<article><p>Core {{}}</p><nav>menu</nav></article><div class=sidebar><p>side</p></div>"
    pages = [page.format(i) for i in range(3)]
    known = w.rules(of(*pages))
    assert [w.extract(p, known) for p in pages] == ["Core 0", "Core 1", "Core 2"]
