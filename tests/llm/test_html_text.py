"""Pages with known text, broken markup, and host templates."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pytest
from conftest import prose

from arbitra.llm.html_text import Page, host_templates, main_text, token_ids

SCHEMA = "page_id long, url string, html string, host string, template string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, (u, h) in enumerate(rows)], SCHEMA)


def texts(df):
    return [r["text"] for r in main_text(df).orderBy("page_id").collect()]


def test_given_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in main_text(df).collect()}
    for r in df.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = (" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", article))
        want = "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


CASES = [
    (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a &amp; b &lt;c&gt;</p><p>d&nbsp; e</p>", "a & b <c>\nd e"), ("<p>one<p>two<ul><li>x<li>y</ul>", "one\ntwo\nx\ny"),
    ("<body><nav>menu</nav><div class='sidebar-left'>side</div><main><h1>T</h1><p>in <b>bold<br>text</p></main><footer>f</footer>", "T\nin bold text"),
    ("<article><header><h1>Title</h1></header><p>body<!-- not this --></p><section id=comments><p>reader</p></section><footer>tags</footer></article>", "Title\nbody"),
    ("<script>var a='<p>no</p>';</script><style>p{}</style><p>yes</p><form><input>Name</form><div class=\"cookie-notice\">ok?</div>", "yes"),
    ("<div role=navigation>m</div><div hidden>h</div><div style='display: none'>n</div><div>kept</div>", "kept"),
    ("<p>unclosed <i>italic", "unclosed italic"), ("<p title='a > b'>attr</p>", "attr"), ("<article><p>5 < 6 and 7 > 3</p></article>", "5 < 6 and 7 > 3"), ("<p>&eacute;&#233;&#xe9;</p>", "ééé"), ("<script>never closed", ""),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<div class='advice'>load</div>", "load"),
    ("<article><p class='social-science'>a field</p><div class='search-results-explained'>of work</div><p class=widget>and a thing</p><noscript><p>said plainly</p></noscript></article>", "a field\nof work\nand a thing\nsaid plainly"),
    ("<article><p>own</p><p class='ad'>buy</p><div class='share-bar'>send</div><div class=newsletter-box>sign up</div><ul class='related-links'><li>more</ul></article>", "own"),
    ("<noscript>Switch scripts on</noscript><div class='search-results-explained'>menu</div><p>kept</p>", "kept"),
    ("<article><p>let <math><mi>x</mi></math> be <svg><text>drawn</text></svg></p><object>as said</object></article>", "let x be drawn\nas said"),
]


def test_cases(spark):
    rows = [(None if i % 2 else f"http://h{i}.example/{i}", h) for i, (h, _) in enumerate(CASES)]
    assert texts(pages(spark, rows)) == [w for _, w in CASES]


def page(i, body):
    return f"<html><body><div class=top><span>Daily News of the Town</span></div><div class=box><p>{body}</p></div><div class=low><span>All about us</span><span>Our terms of use</span><span>Write to us</span></div></body></html>"


def test_template_texts_go(spark):
    bodies = [prose(i, 30) for i in range(6)]
    rows = [(f"https://town.example/{i}", page(i, b)) for i, b in enumerate(bodies)]
    assert texts(pages(spark, rows)) == bodies
    # too few pages for a template: the texts stay
    assert texts(pages(spark, rows[:2]))[0].startswith("Daily News of the Town\n")
    t = host_templates(pages(spark, rows)).collect()
    assert [r["host"] for r in t] == ["town.example"] and len(t[0]["template"]) >= 3


def test_copies_do_not_make_a_template(spark):
    rows = [("https://a.example/", page(0, "the same body everywhere"))] * 9
    assert all("the same body everywhere" in t for t in texts(pages(spark, rows)))


def test_fixed_texts_in_the_article(spark):
    """What every page repeats inside the article goes, but for headings and articles that are alike themselves."""
    rows = [(f"https://b.example/{i}", f"<nav>n</nav><article><h1>Common words here</h1><p>{prose(i, 20)}</p><div class=x><span>Read</span> <i>this</i> <b>too</b></div></article>") for i in range(8)]
    assert texts(pages(spark, rows)) == [f"Common words here\n{prose(i, 20)}" for i in range(8)]
    same = "".join(f"<p>{prose(k, 20)}</p>" for k in range(9))
    rows = [(f"https://c.example/{i}", f"<article>{same}<p>{prose(100 + i, 20)}</p></article>") for i in range(8)]
    assert texts(pages(spark, rows))[3] == "\n".join(prose(k, 20) for k in (*range(9), 103))


def neutral(i, tag):
    """A page whose classes say nothing; the teasers beside the text differ on every page."""
    return (
        f"<html><body><div class=a><div class=b>{prose(900 + i, 3)}</div></div><{tag} class=c><h1>{prose(500 + i, 4)}</h1><div class=d>"
        + "".join(f"<p>{prose(10 * i + k, 30)}</p>" for k in range(1 + i % 3))
        + f"</div></{tag}><div class=e><p>{prose(700 + i, 5)}</p></div></body></html>"
    )


@pytest.mark.parametrize("tag", ["div", "article"])
def test_slots_tell_the_region(spark, tag):
    """Taking the article's tag off changes nothing: the region follows from the template."""
    rows = [(f"https://{'ab'[i % 2]}.example/{i}", neutral(i, tag)) for i in range(16)]
    want = ["\n".join([prose(500 + i, 4), *(prose(10 * i + k, 30) for k in range(1 + i % 3))]) for i in range(16)]
    assert texts(pages(spark, rows)) == want
    regions = {r["host"]: r["region"] for r in host_templates(pages(spark, rows)).collect()}
    assert sorted(regions) == ["a.example", "b.example"] and len(set(regions.values())) == 1


def test_classes_against_brute_force(spark):
    """Tokens of one class are those with the same count on every page of the host."""
    rows = [(f"https://{'ab'[i % 2]}.example/{i}", neutral(i, "div")) for i in range(16)]
    got = {(r["host"], x["token"]): x["class"] for r in host_templates(pages(spark, rows)).collect() for x in r["template"]}
    want: dict = {}
    for host in ("a.example", "b.example"):
        each = [Counter(token_ids(Page(h)).tolist()) for u, h in rows if host in u]
        for t in set().union(*each):
            if 2 * sum(t in c for c in each) >= len(each):
                want.setdefault((host, tuple(c[t] for c in each)), set()).add(t)
    want = {k: v for k, v in want.items() if len(v) >= 3}
    assert set(got) == {(h, t) for (h, _), v in want.items() for t in v}
    for (h, _), v in want.items():
        assert len({got[h, t] for t in v}) == 1
    assert len({got[h, min(v)] for (h, _), v in want.items() if h == "a.example"}) == sum(h == "a.example" for h, _ in want)


def test_empty_table(spark):
    assert main_text(pages(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("n", [300])
def test_long_page(spark, n):
    body = "".join(f"<p>{prose(i, 50)}</p>" for i in range(n))
    assert texts(pages(spark, [("http://x.example/", f"<article>{body}</article>")]))[0].count("\n") == n - 1
