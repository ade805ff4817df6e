import html
import itertools
import re
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import htmltext

PAGES = [
    ("<article><h1>T &lt;i&gt;</h1><p>One  two<br>three <a title='a > b' href=x>link</a>.</p></article>", "T <i>\nOne two three link."),
    ("<article><p><b>A.<br><p>B &amp;&amp; C<p>D.</article><footer>f</footer>", "A.\nB && C\nD."),
    ("<nav><ul><li>Home</nav><article><p>a</p><div class='ad'>Buy</div><aside>x</aside><ul><li>L1<li>L2</ul><section id=comments><p>nice</section></article>", "a\nL1\nL2"),
    ("<main><form><input value=1>name</form><p>text</p><script>var t='</p>';</script><style>p{}</style></main>", "text"),
    ("<article><p>kept<!-- not --></p><p hidden>no</p><p style='display: none'>no</p><div role=alert>no</div></article>", "kept"),
    ("<div class='cookie-notice'>We use cookies on this site, and here is a long line about that.</div><article><p>Be.", "Be."),
    ("<div>" + "Some long text that goes on. " * 6 + "</div><p>short end</p><div class=sidebar>side</div><footer>f</footer>", ("Some long text that goes on. " * 6).strip() + "\nshort end"),
    ("<article><p>a &lt;b&gt; &eacute;&#233;&nbsp;c a < b</p><p", "a <b> éé c a < b"),
    ("<html><head><title>t</title></head><body><p>tiny</body>", "tiny"),
    ("<article></article>", ""),
    ("", ""),
    (None, ""),
]


LONG = ["Some long text of a part that goes on and on, %d. " % k * 4 for k in range(4)]
AD = "<table><tr><td><div class=ad>" + "<p>Buy now</p>" * 5 + "</div></table>"
UNMARKED = [
    "".join(f"<div><div><p>{t}</p></div></div>" for t in LONG),
    "".join(f"<section><div><h2>Part</h2></div><div><p>{t}</p></div></section>" for t in LONG),
    f"<div><p>{LONG[0]}</p>{AD}<p>{LONG[1]}</p></div>" + AD + f"<div><p>Short.</p></div>{AD}<div><p>{LONG[2]}</p></div><div><p>{LONG[3]}</p></div>",
]


REAL = f"<div><p>{LONG[1]}</p></div>"
FALSE_MARKS = [
    f"<!-- <article>old</article> -->{REAL}",
    f"<script>var t = '<article class=x>' + y;</script>{REAL}",
    f"<div data-t='<main>'>{REAL}</div>",
    f"<aside><article><p>teaser of another</p></article></aside>{REAL}",
    f"{REAL}<div class=related><article><h3>Other</h3><p>{LONG[2]}</p></article></div>",
    f"{REAL}<article><a href=x>Another story</a></article>",
    f"<!-- <article> --><main>{REAL}</main><div><p>{LONG[3]}</p></div>",
    f"{REAL}<article></article>",
]


@pytest.mark.parametrize("page", FALSE_MARKS)
def test_marks_that_open_no_article(page):
    assert LONG[1].strip() in htmltext.main_text(page)
    assert not any(LONG[k].strip() in htmltext.main_text(page) for k in (2, 3))


def test_an_article_of_links_alone_stays():
    assert htmltext.main_text("<article><p><a href=x>All of it</a></p></article><div>By us</div>") == "All of it"


SLUGS = [
    ("<article><h2 id='how-search-works'>How</h2><p>a</p></article>", "How\na"),
    ("<article><h2 id=search>Search</h2><section id='related-work'><h2>Related</h2><p>b</p></section></article>", "Search\nRelated\nb"),
    ("<article><p id='privacy-law'>c</p><p class='share-price'>d</p></article>", "c\nd"),
    ("<article><div class='entry-header'><h1>Title</h1></div><p>e</p></article>", "Title\ne"),
    ("<h2 id='how-search-works'>How it works</h2><p>f</p>", "How it works\nf"),
]
PARTS = ["ad-slot-top", "related-posts", "shareButtons", "article__comments", "newsletter-signup", "x social-links", "cookie-notice"]


@pytest.mark.parametrize(("page", "want"), SLUGS)
def test_slugs_name_no_part(page, want):
    assert htmltext.main_text(page) == want


@pytest.mark.parametrize("part", PARTS)
def test_named_parts_of_an_article_are_dropped(part):
    assert htmltext.main_text(f"<article><p>a</p><div class='{part}'>no</div><p class='{part}'>no</p><p>b</p></article>") == "a\nb"


@pytest.mark.parametrize("page", UNMARKED)
def test_unmarked_pages_keep_all_sections(page):
    got = htmltext.main_text(page).split("\n")
    assert [t for t in got if t not in ("Part", "Short.")] == [t.strip() for t in LONG]
    assert got.count("Part") == page.count("Part") and got.count("Short.") == page.count("Short.")


LINKS = "<ul>" + "".join(f"<li><a href=x>Story {k}</a>" for k in range(5)) + "</ul>"


def test_link_lists_around_an_articles_text_go_and_those_within_stay():
    page = f"<article>{LINKS}<h1><a href=x>Title</a></h1><p>One.</p>{LINKS}<p><a href=y>Two.</a></p>{LINKS}</article>"
    inner = [f"Story {k}" for k in range(5)]
    assert htmltext.main_text(page).split("\n") == ["Title", "One.", *inner, "Two."]


def brute_stretches(weights, least):
    """Lines kept by the rule as it is written: those of stretches from the first to the last dense one."""
    n = len(weights)
    sums = [sum(weights[i : i + 3]) for i in range(n)]
    runs = [list(g) for k, g in itertools.groupby(range(n), key=lambda i: sums[i] > 0) if k]
    dense = [k for k, run in enumerate(runs) if any(sums[i] >= least for i in run)]
    chosen = runs[dense[0] : dense[-1] + 1] if dense else runs
    return [i for run in chosen for i in run]


@given(st.lists(st.tuples(st.sampled_from([0, 5, 40, 90]), st.booleans()), max_size=30))
def test_unmarked_pages_against_the_rule(blocks):
    """Blocks of plain text, or of links, which weigh nothing."""
    page = "".join(f"<p>{'x' * n}</p>" if n and not linked else f"<p><a href=x>link {k}</a></p>" for k, (n, linked) in enumerate(blocks))
    texts = ["x" * n if n and not linked else f"link {k}" for k, (n, linked) in enumerate(blocks)]
    weights = [n if not linked else 0 for n, linked in blocks]
    assert htmltext.main_text(page) == "\n".join(texts[i] for i in brute_stretches(weights, 86))


def test_stray_end_tags_under_deep_nesting_take_little_time():
    page = "<div>" * 100_000 + "</b>" * 100_000 + "<p>text</p>"
    began = time.perf_counter()
    assert htmltext.main_text(page) == "text"
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_main_text(page, want):
    assert htmltext.main_text(page) == want


def test_all_articles_of_the_test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/pages.parquet")
    got = {r.page_id: r for r in htmltext.extract(pages.withColumn("TEXT", F.lit(1))).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = r.html[r.html.index("<article>") + 9 :].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id]._text == "\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id]._text)


def test_long_and_empty(spark):
    long = "<article>" + "<p>word word</p>" * 20_000
    df = spark.createDataFrame([(1, "u", long), (1, "u", long), (2, None, None)], "page_id long, url string, html string")
    rows = htmltext.extract(df).collect()
    assert sorted(r.n_chars for r in rows) == [0, 199_999, 199_999]
    assert htmltext.extract(df.where("false")).count() == 0
