import html as std
import re
import time

import pyarrow.parquet as pq
import pytest

from cairn.llm import html, queries

SF = "/root/testdata/sf0.01"


def expected(page):
    """The article's text, by the fixed shape of the test pages."""
    s = re.search(r"<article>(.*?)</article>", page or "", re.S)
    s = re.sub(r"</?(?:p|h1|br)[^>]*>", " ", s[1] if s else "")
    return " ".join(std.unescape(re.sub(r"<[^>]*>", "", s)).split())


def test_whole_table(spark):
    want = {r["page_id"]: (r["url"], expected(r["html"])) for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    got = queries.op8_main_text(spark, SF).collect()
    assert {r["page_id"]: (r["url"], r["text"]) for r in got} == want and len(got) == len(want)
    assert all(r["n_chars"] == len(r["text"]) for r in got)


P = "<p>" + "Plain words of the story go on, and on. " * 6 + "</p>"
WORDS = " ".join(["Plain words of the story go on, and on."] * 6)


def test_other_layouts():
    noise = '<ul class="menu"><li><a href=x>Home</a><li><a href=y>News</a></ul>'
    page = f"<html><body><header>Site</header>{noise}<div id=cookie-notice>We use cookies and other words that are long enough to count.</div><div class='wrap'><div class=post><h2>Title</h2>{P}{P}<blockquote>Short.</blockquote></div><div class='sidebar'>{P}</div></div><section id=comments><div class=comment>{P}</div></section><form>Your name {P}</form><footer>{P}</footer></body></html>"
    assert html.extract(page) == f"Title {WORDS} {WORDS} Short."
    assert html.extract(f"<body>{noise}<main><h1>A&nbsp;&amp; B</h1>{P}<table><tr><td>c1<td>c2</table><script>x('<p>no</p>')</script><style>p</style><!-- <p>no --></main>") == f"A & B {WORDS} c1 c2"
    assert html.extract("just text &lt;b&gt; here") == "just text <b> here"
    assert html.extract("a<b>b</b>c<br>d\n\te") == "abc d e"


def test_cases(spark):
    deep = "<div>" * 20_000 + "deep text" + "</div>" * 20_000
    rows = [(1, None), (2, ""), (3, "<nav>only menu</nav>"), (4, deep), (5, "<p>" + "long " * 200_000), (None, "x"), (6, "</p></div><<<>"), (5, "<p>again")]
    pages = spark.createDataFrame([(i, f"u{i}", h, 1, "q") for i, h in rows], "page_id long, url string, html string, n_chars int, key string")
    got = html.main_text(pages).collect()
    assert sorted(((r["page_id"], r["text"]) for r in got), key=str) == sorted(((i, html.extract(h)) for i, h in rows), key=str)
    by = {r["page_id"]: r["text"] for r in got if r["page_id"] != 5}
    assert by[1] == by[2] == by[3] == "" and by[4] == "deep text" and by[None] == "x"
    assert max(r["n_chars"] for r in got) == 5 * 200_000 - 1
    assert html.main_text(pages.limit(0)).count() == 0


def test_end_tags_above_many_unclosed_elements():
    for n in (10, 600, 5000):
        for tag in ("span", "font"):
            assert html.extract(f"<body><nav>{f'<{tag}>x' * n}</nav><article>{P}</article></body>") == WORDS
        assert html.extract(f"<body><article><ul><li hidden>{'<b>x' * n}<li>{WORDS}</ul></article></body>") == WORDS


S = "The quick story of the town goes on along the river and over the hill, day after day, part %d."
MENU = "<ul><li><a href=/a>Home</a><li><a href=/b>News</a><li><a href=/c>Sport</a><li><a href=/d>About us</a></ul>"
SIDE = "<h3>Latest</h3><ul><li><a href=1>First short link</a><li><a href=2>Second short link</a><li><a href=3>Third</a></ul><p>Follow us.</p>"
FOOT = "<div>&copy; 2024 Example Town Press</div>"


def par(k):
    return " ".join([S % k] * 3)


def p(k):
    return f"<p>{par(k)}</p>"


#: Pages without article, main or telling names: the page and its main text.
LAYOUTS = {
    "block": (f"<body><div>{MENU}</div><div><h1>Title</h1>{p(1)}{p(2)}<p>Short end.</p></div>{FOOT}", ["Title", par(1), par(2), "Short end."]),
    "nested": (f"<body><div><div>Town Press</div><div>{MENU}</div><div><div><h2>Title</h2>{p(1)}<div><p>Yes.</p></div>{p(2)}{p(3)}</div><div>{SIDE}</div></div>{FOOT}</div>", ["Title", par(1), "Yes.", par(2), par(3)]),
    "flat": (f"<body>{MENU}<h1>Title</h1>{p(1)}<ul><li>one<li>two</ul>{p(2)}<div>{SIDE}</div>{FOOT}", ["Title", par(1), "one two", par(2)]),
    "table": (f"<body><table><tr><td colspan=2>{MENU}</td></tr><tr><td><a href=1>A</a><br><a href=2>B</a><br><a href=3>C</a></td><td>{par(1)}<br><br>{par(2)}<br>{par(3)}</td></tr><tr><td colspan=2>Town Press</td></tr></table>", [par(1), par(2), par(3)]),
    "form": (f"<body><form action=x><input type=hidden value=y><div>{MENU}</div><div><h1>Title</h1>{p(1)}{p(2)}</div><select><option>one<option>two</select><label>Search</label></form>", ["Title", par(1), par(2)]),
    "sections": (f"<body><div>{MENU}</div><div><h1>Title</h1>{p(0)}<section><h2>One</h2>{p(1)}{p(2)}{p(3)}</section><section><h2>Two</h2>{p(4)}</section></div><div>{SIDE}</div>{FOOT}", ["Title", par(0), "One", par(1), par(2), par(3), "Two", par(4)]),
    "paragraphs without p": (f"<body><div>{MENU}</div><div><div>{par(1)}</div><div>{par(2)}</div><div>The end.</div></div>{FOOT}", [par(1), par(2), "The end."]),
    "one paragraph": (f"<body><div>{MENU}</div><div><h1>Title</h1><p>{par(1)} <a href=x>see here</a> <b>and</b> <i>there</i>.</p></div><div>{SIDE}</div>{FOOT}", ["Title", par(1), "see here and there."]),
    "header of the text": (f"<body><header>Town Press</header><div>{MENU}</div><div><header><h1>Title</h1></header>{p(1)}{p(2)}</div>{FOOT}", ["Title", par(1), par(2)]),
    "widgets": (f"<body><div class='elementor-widget'><div>{p(1)}{p(2)}</div></div><div class=widget>{SIDE}</div>", [par(1), par(2)]),
    "custom elements": (f"<body><my-app><my-menu>{MENU}</my-menu><my-story><h1>Title</h1>{p(1)}{p(2)}</my-story></my-app>", ["Title", par(1), par(2)]),
}


def test_layouts_without_telling_names():
    for name, (page, want) in LAYOUTS.items():
        assert html.extract(page) == " ".join(want), name


def test_density_decides(monkeypatch):
    monkeypatch.setattr(html, "link_adjusted", lambda *counts: 1.0)
    assert [name for name, (page, want) in LAYOUTS.items() if html.extract(page) == " ".join(want)] == []


def test_whole_table_with_the_article_in_a_plain_block():
    for r in pq.read_table(f"{SF}/pages.parquet").to_pylist():
        assert html.extract((r["html"] or "").replace("article>", "div>")) == expected(r["html"])


def test_reader_comments_and_named_parts_go_whatever_their_density():
    page = f"<body><div id=page class=has-sidebar><div>{p(1)}{p(2)}</div><div id=comments><article>{p(3) * 9}</article></div><div class='cookie-notice'>{p(4) * 9}</div><aside>{p(5) * 9}</aside></div>"
    assert html.extract(page) == f"{par(1)} {par(2)}"


WRAPPERS = "site nav-closed|page menu-open|wrapper footer-fixed|layout sidebar-left|post related-posts-off|container cookies-accepted|content social|page ad-free|post comments-open".split("|")


@pytest.mark.parametrize("name", WRAPPERS)
def test_names_of_what_encloses_the_article_dont_cut_it(name):
    want = f"Title {par(1)} {par(2)} {par(3)}"
    inner = f"<h1>Title</h1>{p(1)}{p(2)}{p(3)}"
    for body in (inner, f"<article>{inner}</article>", f"<div class='layout menu-left'><div class=nav>{MENU}</div><div>{inner}</div><div class=sidebar>{p(4)}</div></div>"):
        assert html.extract(f"<body><div class='{name}'>{body}</div>{FOOT}") == want, body[:20]
    assert html.extract(f"<body><div role=navigation id=x><div>{inner}</div></div>") == want


def test_time_is_in_proportion_to_the_page():
    many = {"<a <b ": "", "<a <b >": "", "<a x='\"> ": "", "<a b='": "", "<!-": "", "<!--": "", "<div>": "", "<main>": "", "<p><a>": "x", "</a =": "", "<form><header>": "x", "&#9999999999": "", "<li hidden>": "", "<nav><span>": "x"}
    pages = {part: lambda n, part=part, end=end: part * (n // len(part)) + end for part, end in many.items()}
    pages |= {f"<div{c}>": lambda n, c=c: f"<div{c * n}>x" for c in (" ", "/", "=", " =", " a")}
    pages["nested names"] = lambda n: "<div class=nav>" * (n // 15) + par(1)

    def took(page):
        began = time.process_time()
        html.extract(page)
        return time.process_time() - began

    for name, page in pages.items():
        small, large = took(page(60_000)), took(page(480_000))  # eight times the page; 64 times the time would be quadratic
        assert large < 24 * max(small, 0.04), (name, small, large)


def test_tokens_as_browsers_read_them():
    assert html.extract("<p title='a > b' data-x=\"<p>\">text</p><script>if (a < b) '</p>'</script><!-- x > y --><? z ?>more") == "text more"
    assert html.extract("1 < 2 & 3 > 2 &amp; &#x41;&#65;&#99999999999999;") == "1 < 2 & 3 > 2 & AA\ufffd"
    assert html.extract("a</>b</ x>c<3") == "abc<3"
    assert html.extract("<p>seen</p><p class='open") == "seen"
    assert html.extract("<p>seen <a href='x>link</a> on</p><p>and on</p>") == "seen link on and on"
