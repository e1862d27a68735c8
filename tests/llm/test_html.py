import html
import re

import pytest

from tagscope.llm import html_templates as ht
from tagscope.llm import queries

PAGE = ("<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='<p>no</p>'</script></head><body class='home sidebar'>"
        "<header><h2>Site</h2></header><nav><ul><li><a href=a>{0}</a></ul></nav><!-- <p>no</p> --><div class=\"cookie-notice\">We use<div>more</div></div>"
        "<article><h1>Title {0} &amp; Co</h1><p>First\n  &lt;b&gt; <b>bold</b>&nbsp;{0}<p>Same on every page.</p><aside>side</aside><form><p>mail</p></form>"
        "<ul><li>one<li>two {0}</ul><div class='ad'>buy</div></article><div id=comments><p>reader {0}</p></div><footer>&copy; x</footer>{1}")
WANT = "Title {0} & Co\nFirst <b> bold {0}\nSame on every page.\none\ntwo {0}"


def test_article_pages():
    pages = [PAGE.format(i, "</body></html>" if i % 3 else "") for i in range(7)]
    assert ht.extract_group(pages) == [WANT.format(i) for i in range(7)]
    assert ht.extract_group(pages[:1]) == [WANT.format(0)]
    assert ht.extract_group([pages[2], pages[2]]) == [WANT.format(2)] * 2


def test_template_without_article():
    page = ("<html><body><div class=bar><a href=/>Home</a><a href=/x>X</a></div><div id=top>Always</div><div id=content><h1>About {0}</h1>"
            "<p>Body {0} text<p>fixed words</p><p>end {0}</p></div><div id=bottom>Imprint always</div></body></html>")
    got = ht.extract_group([page.format(i) for i in ("a", "b", "c")])
    assert got == [f"About {i}\nBody {i} text\nfixed words\nend {i}" for i in ("a", "b", "c")]


def test_classes_are_found():
    parsed = [ht.tokens(PAGE.format(i, "")) for i in range(4)]
    t = ht.deduce(parsed)
    assert [r for r in t.skeleton if r in ("html", "article", "/article", "footer")] == ["html", "article", "/article", "footer"]
    assert t.main[t.skeleton.index("article") + 1] and not t.main[t.skeleton.index("footer") + 1]


def test_broken_pages():
    assert ht.extract_group(["", "plain text only", "<p>a < b & c", "<nav>open <p>x</p>", "<!-- never closed <p>x", "<script>x"]) == \
        ["", "plain text only", "a < b & c", "x", "", ""]
    long = "<article>" + "<p>word &eacute;</p>" * 20_000 + "</article>"
    assert ht.extract_group([long])[0] == "\n".join(["word é"] * 20_000)
    assert ht.extract_group(["<" * 5000 + "<p a='" + "x" * 5000])[0].startswith("<<<")


def test_rows(spark):
    rows = [(1, "http://a.example/x", PAGE.format(1, "")), (1, "http://a.example/x", PAGE.format(1, "")), (None, None, PAGE.format(2, "")),
            (3, "http://a.example/y", None), (4, "no url", ""), (5, "https://u:p@B.example:80?q", PAGE.format(5, ""))]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, text string")
    got = sorted(map(str, ((r.page_id, r.url, r.text, r.n_chars) for r in ht.main_text(df).collect())))
    want = [(r[0], r[1], WANT.format(re.search(r"Title (\d)", r[2])[1]) if r[2] else "") for r in rows]
    assert got == sorted(str((a, u, t, len(t))) for a, u, t in want)
    assert ht.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [0, 1000])
def test_large_host_is_dealt_out(spark, monkeypatch, limit):
    monkeypatch.setattr(ht, "BROADCAST_HOSTS", limit)
    df = spark.createDataFrame([(i, "http://one.example/", PAGE.format(i, "")) for i in range(60)], "page_id long, url string, html string")
    got = ht.main_text(df, group_pages=8)
    assert {r.page_id: r.text for r in got.collect()} == {i: WANT.format(i) for i in range(60)}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in queries.op1_main_text(spark, sf).collect()}
    for p in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.search(r"(?s)<article>(.*?)</article>", p.html)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
        want = "\n".join(b for b in blocks if b)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)


TEASERS = ("<html><body><div class=bar><a href=/>Home</a></div><div class=content><h1>About {0}</h1><p>fixed words<p>Body {0} is the longer text of this page, "
           "{0} it goes on for a while.</div>{1}</body></html>")


@pytest.mark.parametrize("teasers", [
    "<article class=teaser><p>See {0}</p></article><article class=teaser><p>And {0}</p></article>",
    "<article><p>One {0}</p></article>", "<aside><article><p>Only {0} in furniture, and quite as long as the text of the page itself</p></article></aside>",
    "<article><a href=/{0}>linked {0}</a></article><article><a href=/2{0}>again {0}</a></article>"])
def test_articles_that_are_not_the_main_text(teasers):
    for names in ("abc", "a"):
        got = ht.extract_group([TEASERS.format(i, teasers.format(i)) for i in names])
        for i, text in zip(names, got):
            assert f"About {i}\nfixed words\nBody {i} is the longer text of this page, {i} it goes on for a while." in text
            assert "in furniture" not in text and "linked" not in text


def test_two_builds_on_one_host():
    plain = PAGE.replace("First", "First long words " * 20)
    got = ht.extract_group([plain.format(i, "") for i in range(4)] + [TEASERS.format("x", "<article><p>One</p></article>")])
    assert "Body x is the longer text" in got[-1] and all("Title" in t and "reader" not in t for t in got[:-1])


@pytest.mark.parametrize("start, end", [
    ("<form id='aspnetForm'>", "</form>"), ("<div class='layout has-sidebar'>", "</div>"), ("<div id='page' class='with-menu'>", "</div>"),
    ("<div class='header'>", "</div>"), ("<form><div class='has-sidebar'><fieldset>", "</fieldset></div></form>")])
def test_furniture_around_the_main_text(start, end):
    whole = PAGE.replace("{1}", "").replace("<header>", start + "<header>") + end
    close = PAGE.replace("{1}", "").replace("<article>", start + "<article>").replace("</article>", "</article>" + end)
    for page in (whole, close):
        page = page.replace("First", "First long words " * 9)
        for names in ("abc", "a"):
            got = ht.extract_group([page.format(i) for i in names])
            assert got == [WANT.format(i).replace("First", ("First long words " * 9).strip()) for i in names]


@pytest.mark.parametrize("start, end", [("<form id='aspnetForm'>", "</form>"), ("<div class='layout has-sidebar'>", "</div>"), ("<div id='page' class='with-menu'>", "</div>")])
def test_furniture_around_a_page_without_article(start, end):
    page = ("<body>" + start + "<nav><a href=/{0}>{0}</a></nav><h1>About {0}</h1><p>Body {0} text<p>fixed words</p><p>end {0}</p>"
            "<aside>side {0}</aside><footer>imprint</footer>" + end + "</body>")
    assert ht.extract_group([page.format(i) for i in "abc"]) == [f"About {i}\nBody {i} text\nfixed words\nend {i}" for i in "abc"]


def test_comments_longer_than_the_text():
    page = "<body>{1}<h1>About {0}</h1><p>Body {0}</p>{2}<div class='comment-list'>" + "<article><p>reader {0} likes this page</p></article>" * 20 + "</div></body>"
    for a, b in (("", ""), ("<article>", "</article>")):
        assert ht.extract_group([page.format(i, a, b) for i in "abc"]) == [f"About {i}\nBody {i}" for i in "abc"]
