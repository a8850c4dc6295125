"""Main texts of pages."""

from tavola.llm import styletree as st

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header>
<nav><ul><li>Home<li>News</ul></nav><script>var t="</p>";</script><!-- x <p>no</p> --><div class="ad">Buy</div>
<article><h1>One &amp; two</h1><p><b>First<br>line.<p>Second&nbsp;&#233;</p><div class="comments"><p>nice</p></div>
<section><blockquote>Said</blockquote></section></article><aside>More</aside><form><input>Name</form><footer>&copy; x</footer></body></html>"""


def text(html, low=frozenset()):
    return st.main_text(st.parse(html), low)


def test_article():
    assert text(PAGE) == "One & two\n\nFirst line.\n\nSecond é\n\nSaid"


def test_odd_markup():
    assert text(None) == text("") == ""
    assert text("plain &lt;b&gt; text") == "plain <b> text"
    assert text("<p>a<p>b</b></div><li>c<li>d") == "a\n\nb\n\nc\n\nd"
    assert text("<p title='x > y'>in 1 < 2 <b>bold</p>") == "in 1 < 2 bold"
    assert text("<table><tr><td>1<td>2<tr><td>3</table>") == "1 2\n\n3"
    assert text("<p>a</p><script>never closed <p>b") == "a"
    assert text("<div>" * 3000 + "deep") == "deep"
    assert len(text("<p>" + "w " * 300_000)) == 599_999


def pages(spark):
    made = []
    for i in range(40):
        menu = "".join(f"<li>link {k}</li>" for k in range(5))
        made.append((i, f"http://a.example/{i}", f"<body><div class='alpha'><ul>{menu}</ul></div><div class='beta'><p>story {i} begins</p><p>and {i * 7} ends</p></div><div class='gamma'>Same line</div></body>"))
    made += [(100, "http://a.example/z", None), (101, None, "<p>alone</p>"), (102, "http://b.example/", "<body><div class='gamma'>Same line</div></body>")]
    return spark.createDataFrame(made, "page_id long, url string, html string")


def test_repeated_branches_go(spark):
    got = {r["page_id"]: r for r in st.extract(pages(spark)).collect()}
    assert got[3]["text"] == "story 3 begins\n\nand 21 ends" and got[3]["n_chars"] == len(got[3]["text"])
    assert (got[100]["text"], got[100]["n_chars"]) == ("", 0)
    assert got[101]["text"] == "alone"
    assert got[102]["text"] == "Same line"  # nothing else is left of that page


def test_clashing_columns_and_no_rows(spark):
    df = pages(spark).selectExpr("*", "1 AS host", "'old' AS text")
    made = st.extract(df)
    assert made.columns == ["page_id", "url", "html", "host", "text", "n_chars"] and made.count() == 43
    assert st.extract(df.limit(0)).count() == 0


def test_equal_pages_keep_their_text(spark):
    same = spark.createDataFrame([(i, "http://c.example/", "<body><div><p>only text</p></div></body>") for i in range(20)], "page_id long, url string, html string")
    assert {r["text"] for r in st.extract(same).collect()} == {"only text"}


def test_boilerplate_in_an_article_goes(spark):
    made = [
        (i, f"http://d.example/{i}", f"<body><div class='wrap'><article><h1>Title {i}</h1><p>story {i}</p><div class='zeta'><p>Same notice</p></div></article></div></body>")
        for i in range(12)
    ]
    got = {r["page_id"]: r["text"] for r in st.extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i}\n\nstory {i}" for i in range(12)}


def test_story_outside_a_small_article_stays(spark):
    made = [
        (i, f"http://e.example/{i}", f"<body><div class='eta'><p>story {i} begins</p><p>and {i * 7} ends</p></div><article class='card'><p>Read this too</p></article></body>")
        for i in range(12)
    ]
    got = {r["page_id"]: r["text"] for r in st.extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    assert got == {i: f"story {i} begins\n\nand {i * 7} ends" for i in range(12)}


def test_article_is_a_prior():
    inside, beside = (dict.fromkeys(v[3] for v in st.votes(st.parse(h))) for h in ("<main><div>a</div></main>", "<div>b</div><main>c</main>"))
    assert list(inside) == [1] and set(beside) == {1, -1}
    assert {v[3] for v in st.votes(st.parse("<div>b</div><main></main>"))} == {0}


def test_equal_pages_keep_the_article_alone(spark):
    same = [(i, "http://f.example/", "<body><div>Top line</div><article><p>only text</p></article></body>") for i in range(20)]
    assert {r["text"] for r in st.extract(spark.createDataFrame(same, "page_id long, url string, html string")).collect()} == {"only text"}


def test_rare_boilerplate_of_a_large_host_goes(spark):
    made = [
        (i, f"http://g.example/{i}", f"<body><div class='beta'><p>story {i}</p></div>{'<div class=theta>Season notice</div>' if i % 200 == 0 else ''}</body>")
        for i in range(2400)
    ]
    made.append((2400, *made[0][1:]))
    got = {r["page_id"]: r["text"] for r in st.extract(spark.createDataFrame(made, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {i: f"story {i % 2400}" for i in range(2401)}
