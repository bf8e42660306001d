import pytest

from driftspark.llm import pages

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>'
    '<nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy this</div>'
    '<article><h1>Head  line &amp; more</h1><p><b>First {0}<br>line<p>Second<script>x</script> par<b>t</b></p>'
    '<div class="comments"><p>Nice!</p></div></article><aside>Side</aside><footer>&copy; foot</footer></body></html>'
)


def text_of(html):
    return " ".join(t for t, main, frame in pages.blocks(html) if main and not frame)


def test_article_blocks():
    assert text_of(PAGE.format("one")) == "Head line & more First one line Second part"
    assert pages.blocks(None) == pages.blocks("") == []
    assert text_of("<main>a <i>b</i>c<p>d &lt;e&gt; &#233;&nbsp;f</main>") == "a bc d <e> é f"
    assert pages.blocks("a < b and c <d") == [("a < b and c", False, False)]
    assert text_of("<article>x<!-- <p>no</p> --><form>f</form>y<table><tr><td>1<td>2</table></article>") == "x y 1 2"
    assert text_of("<article>" + "<p>w " * 50_000 + "</article>").count("w") == 50_000
    pages.blocks("<a b=\"" * 20_000)
    pages.blocks("<" * 100_000)


def frame_page(n, words):
    top = "this long line stands on top of every page of the host and says nothing about the page at all but takes its place"
    end = "and this other long line ends every page of the same host with links to nowhere and a copyright remark of some years"
    return f"<html><body><div>{top}</div><div>{words(40, n)}</div><nav>menu</nav><div>{end}</div></body></html>"


@pytest.mark.parametrize("in_task", [20_000, 2])
def test_host_suffixes_remove_what_pages_share(spark, words, in_task):
    rows = [(n, "https://user@a.example.org:8080/p?q", frame_page(n, words)) for n in range(6)]
    rows += [(10, "http://b.example.org/", frame_page(50, words)), (11, None, PAGE.format("two")), (12, "x", None)]
    rows += [(13, "http://c.example.org/", "<p>" + "same words again and again " * 30), (None, "", "")]
    table = spark.createDataFrame(
        [(*r, 1, 2, 3) for r in rows], "page_id long, url string, html string, row int, stream int, text int"
    )
    found = {r.page_id: r for r in pages.extract(table, in_task=in_task).collect()}
    assert len(found) == len(rows)
    for n in range(6):
        assert found[n].text == words(40, n)
    # One page of a host shares nothing, not even with itself.
    assert "stands on top" in found[10].text and "menu" not in found[10].text
    assert found[13].text == ("same words again and again " * 30).strip()
    assert found[11].text == "Head line & more First two line Second part"
    assert found[12].text == found[None].text == ""
    assert all(r.n_chars == len(r.text) for r in found.values())


@pytest.mark.parametrize("around", ['div class="has-sidebar"', "form", 'div id="search"', 'section class="social notice"'])
def test_names_around_the_article_do_not_make_it_frame(around):
    tag = around.split()[0]
    side = '<div class="sidebar"><article>teaser</article></div>'
    for main in ("article", "main"):
        page = f'<body><{around}><{main}>real <p>text<div class="share">not</div></{main}>{side}</{tag}></body>'
        assert text_of(page) == "real text"
    assert text_of(f"<article>real</article><aside><article>no</article></aside>{side}") == "real"
    assert text_of('<article>a<div class="comments"><article>no</article></div></article>') == "a"
    assert text_of("<nav><article>no</article></nav>") == ""


def test_host_judges_the_blocks_of_articles(spark, words):
    def page(*blocks):
        return "<article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"

    box, legal, quote = "About the author of this and that", "All rights remain with us", words(30, 999)
    rows = [(n, "http://a.org/", page(words(50, n), box if n < 3 else "no box", legal)) for n in range(12)]
    rows += [(20 + n, f"http://{n}.org/", page(words(50, 20 + n), quote, legal)) for n in range(6)]
    # A quote on three of the host's 20 articles and elsewhere; a text that stands on many pages, and its near copies.
    rows += [(30 + n, "http://a.org/", page(words(50, 30 + n), quote)) for n in range(3)]
    rows += [(40 + n, "http://a.org/", page(words(80, 40), words(70, 41), f"ends {n}")) for n in range(4)]
    rows += [(50 + n, "http://a.org/", page(words(60, 50), "its own")) for n in range(5)]
    found = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(found) == len(rows)
    for n in range(12):
        assert found[n] == words(50, n)
    for n in range(6):
        assert found[20 + n] == f"{words(50, 20 + n)} {quote} {legal}"
    for n in range(3):
        assert found[30 + n] == f"{words(50, 30 + n)} {quote}"
    for n in range(4):
        assert found[40 + n] == f"{words(80, 40)} {words(70, 41)} ends {n}"
    for n in range(5):
        assert found[50 + n] == f"{words(60, 50)} its own"


def test_empty_table(spark):
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
