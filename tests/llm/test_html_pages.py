"""Main text of generated pages, whose article is known, and of broken ones; edge cases of the DataFrame form."""

import html
import random
import time

import pytest

from emberlog.llm import html_text

P = "<p>This is a first paragraph with many words in it, so that it reads like text.</p><p>And a second paragraph, longer than the first, with some more words.</p>"
TWO = "This is a first paragraph with many words in it, so that it reads like text.\nAnd a second paragraph, longer than the first, with some more words."
NOISE = (
    '<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>', '<div class="ad">Buy this now</div>', '<div class="site-footer">&copy; somebody</div>', "<header><a href=/>Home</a> Site name</header>",
    '<div id="cookie-notice">We use cookies</div>', '<aside>Beside</aside>', '<form><label>Name</label><input><button>Send</button></form>', "<script>var x = '<p>no</p>';</script>", "<style>p{}</style>",
    '<section class="comments"><p>First!</p><p>I do not agree with any of this, and here is why.</p></section>', '<div class="left-sidebar"><a href=x>x</a> more</div>', "<footer>foot</footer>", "<!-- <p>hidden</p> -->", "<noscript>turn it on</noscript>",
)


def made(r: random.Random) -> tuple[str, str]:
    """A page and its article's text, which is known by construction."""
    word = lambda: "".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 9)))
    body, blocks = [], []
    for k in range(r.randint(3, 9)):
        words = [word() for _ in range(r.randint(15, 60))]
        if r.random() < 0.3:
            words[0] = "<&>"
        text = " ".join(words)
        space = r.choice([" ", "\n", " \t "])
        inner = space.join(f"<b>{html.escape(w)}</b>" if r.random() < 0.1 else f'<a href="x?a>b">{html.escape(w)}</a>' if r.random() < 0.03 else html.escape(w) for w in words)
        body.append(f"<{'h2' if k == 0 else 'p'}>{inner}" + (f"</{'h2' if k == 0 else 'p'}>" if k == 0 or r.random() < 0.7 else ""))
        blocks.append(text)
        if r.random() < 0.2:
            body.append(r.choice(NOISE[1:2] + NOISE[6:9] + NOISE[12:13]))
    around = r.choice([("<article>", "</article>"), ("<main><div>", "</div></main>"), ('<div class="content has-sidebar">', "</div>"), ('<div id=post class="post no-comments">', "</div>"), ('<section id="public-notice">', "</section>")])
    before, after = (" ".join(r.sample(NOISE, r.randint(0, 4))) for _ in range(2))
    return f"<!doctype html><html><head><title>t</title></head><body>{before}{around[0]}{''.join(body)}{around[1]}{after}</body></html>", "\n".join(blocks)


@pytest.mark.parametrize("seed", range(60))
def test_generated_pages(seed):
    page, want = made(random.Random(seed))
    assert html_text.main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<body><div class="content has-sidebar">{P}</div></body>', TWO),
        (f'<body><form id="page"><h1>Head</h1>{P}</form></body>', "Head\n" + TWO),
        (f"<body><nav><a href=x>m</a><article>{P}</article></body>", TWO),
        (f"<body><article>{P}<button>Click{P}</article></body>", f"{TWO}\nClick\n{TWO}"),
        (f"<body><div><p>One section of some length stands here, as an introduction to it.</p></div><div>{P}{P}</div></body>", f"One section of some length stands here, as an introduction to it.\n{TWO}\n{TWO}"),
        ("a < b and c > d", "a < b and c > d"), ("<p>x &lt;tag&gt; &amp;amp; y", "x <tag> &amp; y"), ("kept <a href=", "kept"), ("", ""), (None, ""), ("<script>only()", "only()"),
    ],
)
def test_pages(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("page", ["<a" * 100_000, "<div>" * 40_000 + "</x>" * 10_000, "<a ='>" * 33_000, "<ul>" + "<b>" * 20_000 + "<li>" * 20_000, "<script>" * 25_000, "<button>" * 20_000 + "<p>" * 20_000, "<" * 200_000, "<!--" * 50_000, "<p><b>" * 33_000])
def test_broken_pages_take_time_in_proportion(page):
    begun = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - begun < 3


def test_rows(spark):
    page = f"<article>{P}</article>"
    rows = [(1, "u", page, "x", 1), (1, "u", page, "x", 1), (None, None, None, None, None), (2, "v", "", "y", 2), (3, "w", "word " * 200_000, "z", 3)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract(frame).collect()))
    long = ("word " * 200_000).strip()
    assert got == sorted([(1, TWO, len(TWO))] * 2 + [(0, "", 0), (2, "", 0), (3, long, len(long))])
    assert html_text.extract(frame.limit(0)).collect() == []
