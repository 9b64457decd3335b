import itertools
import random

from fieldframe.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p>";x(0);</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></nav><!-- ad <p>no</p> -->
<div class="ad">Buy now. It is cheap.</div><div class="cookie-notice"><p>We use cookies on this site to make it better for you.</p></div>
<article><header><h1>Title &lt;1&gt;</h1></header><p><b>First   para&shy;graph.<br><p>Second&nbsp;one, a &amp;amp; b.</p><form><label>Mail</label><input name="q"></form>
<div class="advert-box">Advert</div><ul><li>Point one.<li>Point two.</ul><p>short</p><section id="comments"><h2>Comments</h2><article><p>I like this very much, thank you for it all.</p></article></section></article>
<aside><p>Related: a long story about something else that goes on and on.</p></aside><footer>&copy; site &middot; Words here.</footer></body></html>"""


def test_page():
    assert html_text.main_text(PAGE).split("\n") == ["Title <1>", "First para\xadgraph.", "Second one, a &amp; b.", "Point one.", "Point two.", "short"]


def test_without_article():
    prose = "This is a sentence of the main text that has a good many words in it, and it goes on for a while. "
    page = f"<div id=menu><a href=x>One</a> <a href=y>Two</a></div><div><p>{prose * 3}</p><p>Short one.</p><p>{prose * 2}</p></div><div class=footer>Contact us</div>"
    assert html_text.main_text(page).split("\n") == [(prose * 3).strip(), "Short one.", (prose * 2).strip()]


def test_odd_input():
    for page, text in (("", ""), ("   ", ""), ("<p>", ""), ("<script>x", ""), ("1 < 2 and so on, it is a text. It ends here.", "1 < 2 and so on, it is a text. It ends here."), ("<article>a<b x='>c</article>", "ac"), ("<article><p>x</p", "x")):
        assert html_text.main_text(page) == text, page
    deep = "<div>" * 3000 + "<article><p>Deep text in here.</p></article>"
    assert html_text.main_text(deep) == "Deep text in here."
    assert html_text.main_text("<article>" + "<p>One more line.</p>" * 20_000 + "</article>").count("\n") == 19_999


def test_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randint(1, 9)
        score = [rng.choice((-3, -1, 0, 1, 2)) + rng.random() for _ in range(n)]
        edges = [(a, b, rng.random() * 2) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        cost = lambda keep: sum(max(s, 0) if not k else max(-s, 0) for s, k in zip(score, keep, strict=True)) + sum(c for a, b, c in edges if keep[a] != keep[b])  # noqa: B023, E731
        least = min(cost(k) for k in itertools.product((False, True), repeat=n))
        assert abs(cost(html_text.min_cut(score, edges)) - least) < 1e-6


def test_rows(spark):
    rows = [(1, "u", PAGE, "x"), (None, None, None, "x"), (1, "u", PAGE, None), (2, "v", "", "x")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    text = html_text.main_text(PAGE)
    assert sorted(map(tuple, got), key=str) == sorted([(1, "u", text, len(text)), (None, None, "", 0), (1, "u", text, len(text)), (2, "v", "", 0)], key=str)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_precision_and_recall_without_landmarks():
    """Pages whose article, classes, ids and roles are taken away, against what is found with them: all that is left to the
    classifier and the cut. Characters of whole blocks count."""
    import re
    from collections import Counter

    import pyarrow.parquet as pq

    right = wrong = missed = 0
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist():
        truth = Counter(html_text.main_text(page).split("\n"))
        bare = re.sub(r"\s(class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", re.sub(r"<(/?)(article|main)\b", r"<\1div", page))
        got = Counter(html_text.main_text(bare).split("\n"))
        size = lambda c: sum(len(k) * n for k, n in c.items())
        right, wrong, missed = right + size(truth & got), wrong + size(got - truth), missed + size(truth - got)
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.99
