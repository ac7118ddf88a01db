import pytest
from pyspark.sql import functions as F

from joblume.functions import markup
from joblume.operators.batches import clean_text, is_ready_text, with_page


@pytest.fixture(scope="module")
def clean(spark):
    def run(html, format="markdown", limit=18000):
        pages = spark.createDataFrame([(html,)], "html string")
        return with_page(pages, format).select(clean_text(F.col("page"), limit)).first()[0]
    return run


PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script><style>p{}</style></head><body>
<header>Logo</header><nav><a href="/x">Menu</a></nav>
<main><h1 class="big">Vaga de <b>Python</b></h1><p>Uma <em>boa</em> vaga,<br>remota</p><svg><path d=""/></svg>
<ul><li>Spark</li><li>SQL &amp; mais</li></ul><button>Candidatar</button></main><footer>Contato</footer></body></html>"""


def test_page_is_reduced_to_its_main_content(clean):
    assert clean(PAGE) == "# Vaga de **Python**\nUma *boa* vaga,\nremota\nSpark\nSQL & mais"
    assert clean(PAGE, "text") == "Vaga de Python\nUma boa vaga,\nremota\nSpark\nSQL & mais"


def test_whole_page_without_main_content(clean):
    assert clean("<html><head><title>T</title></head><body><div>a</div><footer>f</footer><p>b</p></body></html>") == "T\na\nb"


@pytest.mark.parametrize("html, selector", [
    ("<div class='description'>d</div><article>a</article>", "article"),
    ("<article>a</article><main>m</main>", "main"),
    ("<div id='main'>1</div><div id='content'>2</div>", "#content"),
    ("<div role='main'>r</div><div class='x post-content'>p</div>", ".post-content"),
    ("<p role='main'>r</p>", '[role="main"]'),
    ("<div id='job-details'>j</div><div class='description'>d</div>", ".description"),
    ("<section class='show-more-less-html__markup'>s</section>", ".show-more-less-html__markup"),
    ("<aside class='description'>gone</aside><p>x</p>", None),
    ("<nav><main>gone</main></nav><p>x</p>", None),
])
def test_main_selector_by_priority_then_place(html, selector):
    assert markup.read_page(html, False)["main_selector"] == selector


def test_first_of_equal_rank_is_taken(clean):
    assert clean("<article>one</article><article>two</article>") == "one"


def test_several_cards_replace_the_main_content(clean):
    card = '<div class="base-search-card"><h3> Dev </h3><span> Acme\n</span><script>x</script></div>'
    assert clean(f"<main>m</main>{card}{card}") == "Dev Acme\n---\nDev Acme"
    assert clean(f"<main>m</main>{card}") == "m"
    assert clean('<div class="x my-job-card-y">a</div><div class="job-card">b</div>') == "a\n---\nb"
    assert clean('<span class="my-job-card">a</span><span class="job-card">b</span>') == "ab"
    assert clean('<ul><li class="jobs-search-results__list-item">a</li><li class="jobs-search-results__list-item">b</ul>') == "a\n---\nb"


@pytest.mark.parametrize("html, expected", [
    ("<h1>a</h1><h2>b</h2><h6>c</h6>", "# a\n## b\n###### c"),
    ("<p><strong>a</strong> <i>b</i> <del>c</del> <code>d_e</code></p>", "**a** *b* ~~c~~ `d_e`"),
    ("<p>2*3_4</p>", r"2\*3\_4"),
    ("<blockquote><p>q</p></blockquote>", "> q"),
    ("a<hr>b", "a\n---\nb"),
    ("<pre>x\n  y_z</pre>", "```\nx\ny_z\n```"),
    ("<table><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table>",
     "| A | B |\n| --- | --- |\n| 1 | 2 |"),
    ("<p><a href='u'>link</a> <img src='i' alt='alt'> <span>s</span></p>", "link  s"),
    ("<!-- c --><p>x</p>", "x"),
    ("<b> </b>x", "x"),
])
def test_markdown(clean, html, expected):
    assert clean(html) == expected


def test_text_is_cut_by_code_points(clean):
    assert clean("<p>" + "é😀" * 50 + "</p>", "text", 7) == "é😀é😀é😀é"


@pytest.mark.parametrize("html", ["<p>a<p>b", "<p><b>a<br><p>b", "<div>a</p></div><div>b", "<![if x]><p>a</p>b", "<p>a</b></i>\n b",
                                  "<table><tr><td>a<td>b</table>".replace("<td>b", "<tr><td>b"), "a<li>b"])
def test_malformed_text_is_kept(clean, html):
    assert clean(html, "text") == "a\nb"


def cards(html):
    return markup.read_page(html, False)["cards"]


def test_cards_in_document_order_each_once():
    found = cards('<ul><li class="job-search-card"><a href="http://x/job/1">1</a><li><a href="/vaga/2">2</a>'
                  '<time datetime="2024-01-01"> a <b>b </b></time><time>late</time></ul><div class="base-search-card">3</div>')
    assert [(c["pos"], c["href"], c["has_time"], c["datetime_attr"], c["time_text"]) for c in found] == [
        (0, "http://x/job/1", False, None, None), (1, "/vaga/2", True, "2024-01-01", "ab"), (2, None, False, None, None)]


def test_only_the_first_matching_link_of_a_card_counts():
    assert cards('<li><a href="http://x/other">o</a><a class="z base-card__full-link">n</a><a href="http://x/job/1">j</a></li>')[0]["href"] is None
    assert cards('<li><a href="http://x/other">o</a><a class="job-search-card__link" href="http://y">n</a></li>')[0]["href"] == "http://y"


def test_nested_cards_share_a_link():
    found = cards('<li>a<ul><li><a href="http://x/job/1">1</a></li></ul></li>')
    assert [c["href"] for c in found] == ["http://x/job/1"] * 2


def test_a_card_does_not_contain_itself():
    assert cards('<a class="job-search-card" href="http://x/job/1">a</a>')[0]["href"] is None
    assert cards('<time class="job-search-card" datetime="d">a</time>')[0]["has_time"] is False


def test_text_nodes(clean):
    two = '<div class="job-card">a<5 &lt; b<!-- c -->d</div>' * 2
    assert clean(two, "text") == "a<5 < b d\n---\na<5 < b d"
    assert cards('<li><time> 1 <!-- x --> day</time></li>')[0]["time_text"] == "1day"


def test_links_are_seen_in_removed_elements_too():
    page = markup.read_page('<nav><a href="http://x/job/1">1</a></nav><a href="http://x/job/2">2</a><a href="/z">z</a>', False)
    assert page["anchors"] == ["http://x/job/1", "http://x/job/2"]


def test_a_failing_page_fails_alone(spark, monkeypatch):
    def feed(self, html):
        if "boom" in html:
            raise ValueError("boom")
        return super(markup.PageReader, self).feed(html)

    monkeypatch.setattr(markup.PageReader, "feed", feed)
    assert markup.read_page("boom", False)["parse_error"] == "ValueError: boom"
    monkeypatch.undo()
    pages = spark.createDataFrame([(1, "<p>a</p>"), (2, None), (3, "")], "id int, html string")
    rows = with_page(pages, "text").select("id", "page.parse_error", clean_text(F.col("page")).alias("t")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, None, "a"), (2, "no content", None), (3, None, "")]


def test_deep_nesting_is_no_problem():
    page = markup.read_page("<div><span>" * 20000 + "x" + "<p>y", True)
    assert page["body"].split() == ["x", "y"]


def test_pages_are_read_once_even_below_a_filter(spark):
    pages = spark.createDataFrame([("<li><a href='http://x/job/1'>",)], "html string")
    links = with_page(pages).select(F.explode("page.cards").alias("c")).where("c.href is not null")
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_route(apply):
    texts = ["<p>", "  \n\x1f<p>", "plain", "", "<p>=== NOVA VAGA ===", "﻿<p>"]
    expected = ["=== NOVA VAGA ===" in t or not t.strip().startswith("<") for t in texts]
    assert apply(texts, is_ready_text) == expected
