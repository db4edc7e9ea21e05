import pytest

from terracell.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="home">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="wrap"><div class="{cls}"><h2>Head &amp; line</h2><p>First   para with <b>bold</b> and a <a href="x">link</a>.</p>
<script>var a = "<p>no</p>";</script><p>Second&nbsp;para &#233;.<br>after</p><!-- <p>hidden</p> --></div>
<div class="sidebar"><p>Related things to read elsewhere</p></div>
<div class="comments"><p>Reader comment that is fairly long, longer than the text above, one hopes, and even more words.</p></div></div>
<form><p>Sign up</p><input name="q"></form><footer><p>Copyright</p></footer></body></html>"""
TEXT = "Head & line\nFirst para with bold and a link.\nSecond para é. after"


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "1 as path", "2 as salt").repartition(3)


@pytest.mark.parametrize("most", [html.BROADCAST_BYTES, -1])
def test_extraction(spark, monkeypatch, most):
    monkeypatch.setattr(html, "BROADCAST_BYTES", most)
    rows = [(i, f"http://a.example/{i}", PAGE.format(cls=f"post-{i} body")) for i in range(20)]
    rows += [(50, "http://b.example/", None), (51, None, ""), (52, None, "<p>bare &lt;words&gt;</p>"), (53, "nothing", "plain text"), (53, "nothing", "plain text")]
    got = sorted(html.extract(frame(spark, rows)).collect(), key=lambda r: r["page_id"])
    assert len(got) == len(rows)
    assert all(r["text"] == TEXT and r["n_chars"] == len(TEXT) for r in got[:20])
    assert [r["text"] for r in got[20:]] == ["", "", "bare <words>", "plain text", "plain text"]


def test_consensus_overrules_one_page(spark):
    """A page whose longest container is a widget is read along its host's winning path."""
    other = "<div class='frame'><p>" + "Unrelated long block of words. " * 30 + "</p></div>"
    body = "<body><div class='main-text'><p>{}</p></div>{}</body>"
    rows = [(i, "http://c.example/x", body.format("The story goes on for a good while here. " * 5, "")) for i in range(9)]
    rows.append((9, "http://c.example/y", body.format("A short story.", other)))
    got = {r["page_id"]: r["text"] for r in html.extract(frame(spark, rows)).collect()}
    assert got[9] == "A short story."


def test_tolerates_broken_markup(spark):
    rows = [(1, "u", "<div><p>one<p>two</div></div><b>three"), (2, "u", "<"), (3, "u", "<div class=\"a"), (4, "u", "<!-- open"), (5, "u", "<script>never closed"), (6, "u", "a < b and c > d")]
    got = {r["page_id"]: r["text"] for r in html.extract(frame(spark, rows)).collect()}
    assert got[1].startswith("one\ntwo") and got[4] == "" and got[5] == ""
    assert html.extract(frame(spark, []).where("false")).count() == 0


def text(source):
    page = html.Page(source)
    best = page.best()
    return page.text(page.path(best[0]) if best else None)


def test_forms_and_class_names():
    article = "<article><h1>T</h1><p>Some text here</p></article>"
    assert text(f"<body><form id='aspnet'><div>{article}</div><input><button>go</button><select><option>x</select></form></body>") == "T\nSome text here"
    assert text("<body><form><div class=x><p>Only this form holds the text</p></div></form><p>less</p></body>").startswith("Only this form")
    assert text(f"<body>{article}<form><p>Sign up</p></form></body>") == "T\nSome text here"
    assert text("<p>one<form><p>Your name</p></form><p>This is longer text") == "one\nThis is longer text"
    assert text('<body><div class="post no-sidebar"><p>Some text here</p></div><div class="siteFooter">foot</div><div id="page-header">head</div></body>') == "Some text here"
    assert text('<body><div class="lead"><p>The lead of the story</p></div><div class="rest"><p>' + "And all the rest of it. " * 20 + "</p></div></body>").startswith("The lead of the story\nAnd all")


@pytest.mark.parametrize("source", ["<div>x" * 100_000, "<a " * 100_000, "</b>" * 100_000 + "</i>x" * 100_000, "<h1><h2>" * 50_000, '<a "' * 50_000 + ">", "x<!--" * 50_000, "<b>" * 50_000 + "<p>" * 50_000])
def test_deep_and_unclosed_pages_take_linear_time(source):
    import time
    import tracemalloc

    began = time.thread_time()
    text(source)
    assert time.thread_time() - began < 30  # quadratic time takes minutes
    tracemalloc.start()
    html.Page(source[: len(source) // 10])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 * len(source) / 10 + 1_000_000


def test_equals_a_plain_reading(spark):
    """Generated pages, whose articles are known, come back word for word."""
    import random

    rng = random.Random(5)
    rows, want = [], {}
    for i in range(60):
        blocks = [" ".join(rng.choices(["alpha", "beta", "gamma &amp; delta", "&eacute;t&eacute;", "x &lt; y"], k=rng.randint(8, 30))) for _ in range(rng.randint(1, 6))]
        rest = ["<nav><a href=/>Home</a></nav>", "<aside>Related</aside>", "<div class='cookie-notice'>We use cookies</div>", "<form><p>Join</p></form>", "<script>if (a<b) {}</script>", "<div class='comments'><p>" + "me too " * 40 + "</p></div>"]
        rng.shuffle(rest)
        cut = rng.randint(0, len(rest))
        body = "".join(f"<{t}>{b.replace(' ', chr(10), 1)}</{t}>" for b in blocks for t in [rng.choice(["p", "h2", "blockquote", "li"])])
        wrap = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div class='post-7 hentry'><div class='inner'>{}</div></div>"])
        rows.append((i, f"http://h{i % 3}.example/{i}", "<body>" + "".join(rest[:cut]) + wrap.format(body) + "".join(rest[cut:]) + "</body>"))
        want[i] = "\n".join(b.replace("&amp;", "&").replace("&eacute;", "é").replace("&lt;", "<") for b in blocks)
    got = {r["page_id"]: r["text"] for r in html.extract(frame(spark, rows)).collect()}
    assert got == want
