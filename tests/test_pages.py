from html import unescape

from pyspark.sql import functions as F

from topicloom.functions import html
from topicloom.operators import content, links

LONG = "word " * 30
P51, P50 = "x" * 51, "y" * 50


def text_of(spark, html, **options):
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    row = content.page_text(pages, **options).first()
    return row["case_text"], row["rule"]


def test_selected_block(spark):
    html = f'<div class="caselawcontent searchable-content"><p> {LONG}</p> <b>end </b></div><div class="caselawcontent searchable-content">short</div>'
    assert text_of(spark, html) == (LONG.strip() + " end", "selector")


def test_first_matching_selector_ends_the_chain(spark):
    html = f'<div class="caselawcontent">short</div><div class="my-opinion">{LONG}</div><p>{P51}</p>'
    assert text_of(spark, html) == (P51, "paragraph")


def test_nested_match_repeats_its_text(spark):
    html = f'<div class="content">{LONG}<div class="content">{LONG}</div></div>'
    once = LONG.strip()
    assert text_of(spark, html) == (f"{once} {once} {once}", "selector")


def test_class_substring_is_tried_on_the_whole_value(spark):
    assert text_of(spark, f'<div class="a b-case">{LONG}</div>') == (LONG.strip(), "selector")
    assert text_of(spark, f'<section class="case">{LONG}</section>')[1] == "none"


def test_paragraphs_join_their_nodes_without_a_blank(spark):
    html = f"<p>{P50}</p><p>{P51}</p><p>{'a' * 30} <i> {'b' * 30} </i></p>"
    assert text_of(spark, html) == (f"{P51} {'a' * 30}{'b' * 30}", "paragraph")


def test_whole_page(spark):
    assert text_of(spark, "<body>" + "z" * 201) == ("z" * 201, "page")
    assert text_of(spark, "<body>" + "z" * 200) == ("", "none")
    assert text_of(spark, None) == ("", "none")
    assert text_of(spark, "") == ("", "none")


def test_traps(spark):
    html = f'<script>var t = "</p><p>{P51}";</script><!-- <p>{P51}</p> --><p><b>{"a" * 60}<br>c<p>{"d" * 60}&amp;<div>{P51}</div>'
    assert text_of(spark, html) == (f"{'a' * 60}c {'d' * 60}&", "paragraph")


def test_exact_class(spark):
    html = '<span class="caselawcontent searchable-content"> a <b>b</b></span><div class="caselawcontent">no</div><p class="caselawcontent searchable-content">c</p>'
    pages = spark.createDataFrame([(1, html), (2, "<p>x</p>")], "page_id long, html string")
    got = {r["page_id"]: r["case_text"] for r in content.page_text_exact(pages).collect()}
    assert got == {1: " a b c", 2: ""}


def test_anchors(spark):
    html = """<a href="/x/1.html">One <b>two</b></a><a name=top>none</a><A class=c HREF='/y?a=1&amp;b=2'>&lt;y&gt;</A><a
      href=/z/3>three</a><!-- <a href="/hidden">h</a> --><abbr>no</abbr><a data-href="/no" href="/yes">yes</a>"""
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = [(r["href"], r["text"]) for r in links.explode_anchors(pages).orderBy("position").collect()]
    assert got == [("/x/1.html", "Onetwo"), ("", "none"), ("/y?a=1&b=2", "<y>"), ("/z/3", "three"), ("/yes", "yes")]


def test_case_links(spark):
    hrefs = ["/c/us/1.html", "/c/us/1.html", "/c/years/2", "/other/3", "/c/us/none", "/c/us/a-b"]
    found = spark.createDataFrame([(1, i, h) for i, h in enumerate(hrefs)], "page_id long, position int, href string")
    kept = links.case_links(found, "/c/", "/years/")
    assert [(r.href, r.docket) for r in kept.orderBy("position").collect()] == [("/c/us/1.html", "1"), ("/c/us/1.html", "1"), ("/c/us/a-b", "-")]
    assert {(r[0], r[1]) for r in links.distinct_links(kept).collect()} == {("/c/us/1.html", "1"), ("/c/us/a-b", "-")}


def test_study_links_try_the_whole_tag(spark):
    found = spark.createDataFrame([("<a title='us' href='/x/1a'>t</a>", "/x/1a"), ("<a href='/us/2'>years</a>", "/us/2"), ("<a href='/us/c'>t</a>", "/us/c")], "tag string, href string")
    kept = links.case_links_study(found, "us", "years", "/court/")
    assert {(r.href, r.docket) for r in kept.collect()} == {("/x/1a", "1"), ("/us/c", "")}


def test_preview_and_profile(spark):
    html = "<title>T &amp; U</title><section class='x decision'></section><div class=cases></div><div></div>" + "".join(f'<a href="/c/{i}-{i}">{"t" * 60}</a>' for i in range(7))
    pages = spark.createDataFrame([(1, html), (2, "<p></p>")], "page_id long, html string")
    preview = links.link_preview(pages, "/c/", "/years/").orderBy("rank").collect()
    assert [(r["rank"], r.docket, len(r.title)) for r in preview] == [(1, "0-0", 50), (2, "1-1", 50), (3, "2-2", 50)]
    profile = {(r.page_id, r.pattern): (r.matches, len(r.samples)) for r in links.link_patterns(pages, "c", "zz").collect()}
    assert profile[(1, "word")] == (7, 5) and profile[(1, "number")] == (7, 5) and profile[(1, "phrase")] == (0, 0)
    shapes = {r.page_id: (r.title, r.containers) for r in links.page_profile(pages).collect()}
    assert shapes == {1: ("T & U", 2), 2: ("No title", 0)}
    counts = {r.page_id: r.n_links for r in links.links_per_page(pages, "/c/", "/years/").collect()}
    assert counts == {1: 7, 2: 0}


def test_a_new_anchor_ends_an_open_one(spark):
    from topicloom.operators.links import explode_anchors

    pages = spark.createDataFrame([(1, '<a href="/x/1">one <a href="/x/2">two</a><a href="/x/3">three')], "page_id long, html string")
    rows = explode_anchors(pages).orderBy("position").collect()
    assert [(r["href"], r["text"]) for r in rows] == [("/x/1", "one"), ("/x/2", "two"), ("/x/3", "three")]


def test_repeated_page_gives_one_case(spark):
    from topicloom.plans.collect import extract_text

    html = "<p>" + "word " * 40 + "</p>"
    pages = spark.createDataFrame([(1, "u", html), (1, "u", html), (1, "v", html)], "page_id long, url string, html string")
    cases = spark.createDataFrame([("u",), ("w",)], "case_url string")
    got = {r["case_url"]: r["case_text"] for r in extract_text(cases, pages).collect()}
    assert extract_text(cases, pages).count() == 2 and got["u"].startswith("word") and got["w"] == ""


def test_every_character_reference(spark):
    """Named with and without semicolon, the longest name first, numbers in both bases, unknown ones left."""
    cases = {
        "caf&eacute; &copy; &amp;lt;": "café © &lt;",
        "&#x2F;&#47;&#X2f;&#233;&#xe9": "///éé",
        "&notit; &notin; &not &AMP": "¬it; ∉ ¬ &",
        "a & b &; &x; &unknown; &#; &#x;": "a & b &; &x; &unknown; &#; &#x;",
        "&#128; &#x80; &#0; &#55296; &#1114112; &#99999999999999999999; &#13;": "€ € � � � � \r",
        "&#x1F600; &NotEqualTilde; &fjlig;": "😀 ≂̸ fj",
        "&nbsp;": " ",
        "&#1;&#xFDD0;": "",
        "none": "none",
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*cases, None])], "i int, t string")
    got = {r.t: r.u for r in rows.select("t", html.unescape(F.col("t")).alias("u")).collect()}
    assert got == cases | {None: None}
    assert all(unescape(t) == u for t, u in cases.items())


def test_references_in_an_address_and_in_text_nodes(spark):
    page = '<a href="/x/3&#x2F;y?a=1&copy=2&lt;&eacute;&amp=3&para">caf&eacute; &nbsp;<b>&nbsp;</b>&#160;&copy; x</a><title>&Eacute;t&#233;</title>'
    pages = spark.createDataFrame([(1, page)], "page_id long, html string")
    row = links.explode_anchors(pages).first()
    assert (row["href"], row["text"]) == ("/x/3/y?a=1&copy=2<é&amp=3¶", "café© x")
    assert links.page_profile(pages).first()["title"] == "Été"
