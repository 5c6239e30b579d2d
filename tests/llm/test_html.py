"""Page texts: elements and their meaning by small pages, template classes against plain vectors, whole tables against SQL."""

from __future__ import annotations

import duckdb
import pytest

from memlake.llm import html_text as h
from memlake.llm.queries import ORACLE_SQL

LONG = "A paragraph with many words in it, so that it reads like the body of a text."


def text(page, template=frozenset(), links=frozenset()):
    return h.main_text(h.parse(page, {}), template, links)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<p>a &lt;b&gt; &eacute;&#233;&#xe9; &nbsp; &notit; x&copy</p>", "a <b> ééé ¬it; x©"),
        ("<html><head><title>T</title></head><body><p>one<p>two<div>three<br>four</div>five", "one\ntwo\nthree four\nfive"),
        ("<body><p>a  \n b<b>c</b> <i>d</i></p></body>", "a bc d"),
        ("<article><p>in</p><aside>no</aside><p>on</p></article><p>out</p>", "in\non"),
        ("<nav><a href=x>n</a></nav><header><h1>Site</h1></header><main><h1>T</h1><p>x</p><form>f<input></form></main><footer>f</footer>", "T\nx"),
        ("<article><header><h1>T</h1><p>by me</p></header><p>x</p><footer>tags</footer></article>", "T\nx"),
        ("<article><p>x</p><section class='comments'><article class=comment><p>reader</p></article></section></article>", "x"),
        ("<body class='has-sidebar no-ads'><div id=content><p>x</p><div class='ad-box'>buy</div><div class=share-links>s</div></div><div id=sidebar>s</div></body>", "x"),
        ("<div role=banner>b</div><div role='main'><p>x</p></div><div role=contentinfo>c</div>", "x"),
        ("<article>a<script>if (a<b) '</p>'; x=\"</article>\"</script>b<style>p{}</style><!-- <p>no</p> -->c<noscript>n</noscript></article>", "abc"),
        ("<article><p>x</p><div hidden>h</div><div style='display: none'>d</div><p aria-hidden=true>a</p></article>", "x"),
        ("<article><ul><li>one<li>two<ul><li>three</ul></ul><table><tr><td>a<td>b<tr><td>c</table></article>", "one\ntwo\nthree\na\nb\nc"),
        ("<article><p>cut <b>here<br><p>next &am", "cut here\nnext &am"),
        ("<article><p>cut</p><foo", "cut"),
        ("<article><p>a < b and 3 > 2</p><p title='x > y'>z</p></article>", "a < b and 3 > 2\nz"),
        ("<script>never closed <p>x</p>", ""),
        ("<ARTICLE><P>Big</P></ARTICLE>", "Big"),
        ("<article><p>word <span class='advert'>ad</span> word</p></article>", "word word"),
        ("<article></article><div><p>x</p></div>", "x"),
        ("<p>a</p></div></article><p>b", "a\nb"),
    ],
)
def test_elements(page, want):
    assert text(page) == want


def test_long_and_broken_pages_take_linear_time():
    """Unclosed quotes, comments and elements by the hundred thousand."""
    n = 100_000
    assert text("<article><p>" + "<b>" * n + "x") == "x"
    assert text("<article>" + '<a title="' * n) == ""
    assert text("<article>" + "<p>y" * n).count("y") == n
    assert text("<article>x" + "<" * n + "<!--" * n).startswith("x<")
    assert len(text("<article>" + "word " * (5 * n))) == 25 * n - 1


def site(i, body, notice=True):
    links = "".join(f"<li><a href=/{k}>{k}{i}</a>" for k in range(i % 4 + 1))
    return f"<html><body><div class=x7><ul>{links}</ul></div><div class=q1>{'<div class=q2><span>We use things</span></div>' if notice else ''}{body}</div><div class=z3><p>All rights kept</p></div></body></html>"


def pages_of(rows, spark):
    return spark.createDataFrame([(i, u, p, "own host", "own text") for i, (u, p) in enumerate(rows)], "page_id long, url string, html string, host string, text string")


def test_templates_take_unnamed_boilerplate(spark):
    """Neither tags nor names tell what menus, notices and footers are here; the host's classes do."""
    rows = [(f"https://Host.example.org:80/{i}", site(i, f"<p>Text {i} {LONG}</p><p>Again {i}</p>" + "<p>Shared line</p>" * (i % 3 == 0), i % 2 == 0)) for i in range(12)]
    rows += [("http://other.example.org/1", site(1, "<p>Alone</p>")), (None, site(1, "<p>No host</p>")), ("nonsense", None), ("http://host.example.org/9", "")]
    got = {r.page_id: r.text for r in h.extract_pages(pages_of(rows, spark).repartition(3)).collect()}
    for i in range(12):
        assert got[i] == f"Text {i} {LONG}\nAgain {i}" + "\nShared line" * (i % 3 == 0)
    assert got[12].split("\n") == ["01", "11", "We use things", "Alone", "All rights kept"]  # one page shows no template
    assert got[13].endswith("No host\nAll rights kept") and got[14] == got[15] == ""


def test_copies_of_an_article_are_no_template(spark):
    """Hundreds of pages alike count once, and an article's plain paragraphs stay where all pages of a host share them."""
    rows = [("http://a.org/1", f"<body><div>{i % 2}</div><article><h1>T</h1><p>{LONG}</p><div class=k>Read on</div></article></body>") for i in range(300)]
    rows += [("http://b.org/1", f"<body><div>{i}</div><article><h1>T</h1><p>{LONG}</p><div class=k>Read on</div></article></body>") for i in range(40)]
    got = [(r.url, r.text) for r in h.extract_pages(pages_of(rows, spark)).collect()]
    assert set(got) == {("http://a.org/1", f"T\n{LONG}\nRead on"), ("http://b.org/1", f"T\n{LONG}")} and len(got) == 340


def test_rounds():
    members, above = {1: 10, 2: 10, 3: 20, 4: 20, 5: 30}, {10: 0, 20: 1, 30: 2}
    found = {c: (order, slot) for c, order, slot in h.rounds([1, 3, 4, 9, 3, 4, 5, 2], members, above)}
    assert found[20][0] and found[20][1] == 1 and found[30][1] == 4 and found[10][1] == 1
    assert {c: order == 0 for c, order, _ in h.rounds([1, 3, 4, 4, 3, 2], members, above)} == {10: False, 20: True}
    assert {c: slot for c, _, slot in h.rounds([1, 3, 2, 4], members, above)}[20] == 0  # a round that spans a token above


def test_classes_are_those_of_plain_vectors(spark):
    """Template tokens of a host equal those that whole vectors, kept in a dictionary, give."""
    sources = [site(i, f"<p>Text {i}</p>", i % 3 != 0) for i in range(9)]
    got = h.templates(spark.createDataFrame([("s", p) for p in sources], "host string, html string")).first()
    vectors = {}
    for i, p in enumerate(sources):
        for t in h.tokens(h.parse(p, {}))[0]:
            vectors.setdefault(t, [0] * 9)[i] += 1
    alike = {}
    for t, v in vectors.items():
        if sum(map(bool, v)) >= 3:
            alike.setdefault(tuple(v), []).append(t)
    assert set(got.template) <= {t for ts in alike.values() if len(ts) > 1 for t in ts}
    assert {len([t for t in ts if t in got.template]) / len(ts) for ts in alike.values() if len(ts) > 1} == {1.0}


def test_odd_and_no_rows(spark):
    rows = [(None, None), ("", ""), ("http://x.org/", "  \n "), ("http://x.org/", "<p>a</p>"), ("http://x.org/", "<p>a</p>"), ("http://x.org/", "<article>" + "<p>w</p>" * 50_000)]
    df = pages_of(rows, spark)
    got = sorted((r.page_id, r.url, r.text, r.n_chars) for r in h.extract_pages(df).collect())
    assert [g[2:] for g in got] == [("", 0), ("", 0), ("", 0), ("a", 1), ("a", 1), ("\n".join("w" * 50_000), 99_999)]
    assert h.extract_pages(df.limit(0)).collect() == []


def test_table(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{data}/pages.parquet'")
    assert sorted(tuple(r) for r in h.extract_pages(pages).collect()) == sorted(con.sql(ORACLE_SQL["op11_html"]).fetchall())
