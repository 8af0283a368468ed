import pytest

from aridscape.llm import pages

PAGE = """<!doctype html><html><head><title>T &amp; t</title><style>p{}</style></head><body class="has-sidebar">
<header class="site-header"><h1>Site</h1><p>Slogan, long and with punctuation. Yes, really, it is.</p></header>
<nav><a href=1>Home</a><a href=2>News</a></nav><div class="cookie-notice"><p>We use cookies, to improve, your experience. Accept.</p></div>
<main><article><header><h1>Real &amp; title</h1></header><!-- <p>no</p> --><p>First  paragraph,
with <b>bold</b> text and a <a href=x>link</a>. It is long enough, surely.<p>Short.
<ul><li>One<li>Two items, here.</ul><form><input><label>Email</label><button>Go</button></form><blockquote>Quote&nbsp;here, said somebody&#33;</blockquote>
<div class="share-buttons"><a>fb</a></div><table><tr><td>a<td>b</table><script>var a = "<p>no</p>";</script></article>
<section id="comments"><h2>Comments</h2><div class="comment"><p>Great article, I loved it, thanks. Really a very long comment, with many, many commas, and so on.</p></div></section></main>
<aside><p>Sidebar, text. With punctuation, too.</p></aside><div class="related"><ul><li><a>r1</a><li><a>r2</a></ul></div><footer>&copy; x</footer></body></html>"""
TEXT = "First paragraph, with bold text and a link. It is long enough, surely.\nShort.\nOne\nTwo items, here.\nQuote here, said somebody!\na\nb"


def test_article_alone():
    assert pages.main_text(PAGE) == "Real & title\n" + TEXT


def test_article_without_its_tag():
    plain = PAGE.replace("<article>", '<div class="post">').replace("</article>", "</div>").replace("main>", "div>").replace("<header><h1>Real", "<h1>Real").replace("title</h1></header>", "title</h1>")
    assert pages.main_text(plain) == "Real & title\n" + TEXT


def test_rich_block_wins_over_link_lists():
    links = "".join(f"<li><a href={i}>Some headline number {i}</a></li>" for i in range(30))
    text = "".join(f"<p>Sentence {i}, which goes on, and on. It ends here.</p>" for i in range(5))
    got = pages.main_text(f"<body><div><ul>{links}</ul></div><div>{text}</div></body>")
    assert got == "\n".join(f"Sentence {i}, which goes on, and on. It ends here." for i in range(5))


def sentences(name, n):
    return [f"{name} {i}, which goes on, and on, for a while. It ends here, at last." for i in range(n)]


def test_lead_and_title_beside_the_content():
    text = sentences("Sentence", 9)
    lead = "The lead, long as it is, sums up all of it. It says, briefly, what follows, and why."
    page = f"<body><h1>Title</h1><p>{lead}</p><div class=content>{''.join(f'<p>{x}</p>' for x in text)}</div></body>"
    assert pages.main_text(page) == "\n".join(["Title", lead, *text])
    assert pages.main_text(page.replace(lead, "By A B")) == "\n".join(["Title", "By A B", *text])


def test_sections_side_by_side():
    one, two = sentences("First", 8), sentences("Second", 2)
    page = "<body><nav>Menu</nav><div>" + "".join(f"<section><h2>{h}</h2>{''.join(f'<p>{x}</p>' for x in t)}</section>" for h, t in (("A", one), ("B", two))) + "</div></body>"
    assert pages.main_text(page) == "\n".join(["A", *one, "B", *two])
    assert pages.main_text(page.replace("<section><h2>B", "<section class=more><h2>B")) == "\n".join(["A", *one, "B", *two])


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("  \n ", ""),
        ("just text &lt;b&gt; &#233;", "just text <b> é"),
        ("<p>a<p>b<div>c</div>d", "a\nb\nc\nd"),
        ("<article><p>unclosed <b>bold<br>line<p>next</i></article>", "unclosed bold line\nnext"),
        ("<script>only()", ""),
        ("<p>1 < 2 and <3", "1 < 2 and <3"),
        ("<p>cut <a href='x", "cut"),
        ("<p>" + "word " * 50_000 + "</p>", " ".join(["word"] * 50_000)),
    ],
)
def test_odd_pages(page, want):
    assert pages.main_text(page) == want


def test_table(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)]
    out = pages.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in out) == [(0, 0), (1, len(TEXT) + 13), (1, len(TEXT) + 13)]
    assert all(r.n_chars == len(r.text) for r in out)
    assert pages.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
