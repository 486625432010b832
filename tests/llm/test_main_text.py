import random

import numpy as np
import pytest

from docloom.llm import main_text as mt

TREE = mt.grow(*mt.labelled_blocks())
BODY = "Rain fell over the old harbour all week and the ferries stayed in port, so the market sold what the farms could bring by road."
MORE = "On Friday the wind turned and the boats went out again before dawn, each with its lamps lit, while the crowd watched from the wall."


def text(page):
    return mt.texts_of([page], TREE)[0]


def test_tree_learns_its_table_and_takes_the_best_split():
    x, y = mt.labelled_blocks()
    assert (TREE.predict(x) == y).all()
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 6, (80, 3)).astype(float), rng.integers(0, 2, 80)
    tree = mt.grow(x, y, 1)

    def gini(rows):
        p = y[rows].mean() if rows.any() else 0
        return rows.sum() * p * (1 - p)

    best = min((gini(x[:, f] <= c) + gini(x[:, f] > c), f, c) for f in range(3) for c in np.arange(0.5, 5))
    assert (tree.feature[0], tree.threshold[0]) == best[1:]


def test_everything_around_an_article_goes():
    page = f"""<html><head><title>T</title><script>if (a < b) document.write("<p>no</p>")</script></head><body>
    <header><a href=/>Site</a> <p>The best news</p></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
    <div class="cookie-notice">We use cookies to make this page better for all of our readers. <button>OK</button></div>
    <article class="post"><header><h1>Storm &amp; harbour</h1></header><p>{BODY}<br>Next&nbsp;line<p class=ad>Buy a boat now, cheap and dry, today only.</p>
    <p>So&#x21; <b>Bold</b>ly <i>said</i>.<ul><li>One thing<li>Another thing</ul><span class="share">Share this</span>
    <form><p>Sign up for our letter with all news of the week</p><input></form><aside><p>{MORE}</p></aside>
    <section id="comments"><article><p>{MORE} I was there and can say so.</p></article></section></article>
    <div class="sidebar"><p>{MORE}</p></div><footer>&copy; Site. {MORE}</footer><!-- <article>{BODY}</article> --><style>p{{}}</style></body></html>"""
    assert text(page) == "\n\n".join(["Storm & harbour", f"{BODY} Next line", "So! Boldly said.", "One thing", "Another thing"])


def test_pages_without_names_are_read_by_shape():
    links = "".join(f"<td><a href={i}>Link {i}</a>" for i in range(6))
    page = f"<table><tr>{links}</table><div><h2>Storm in the harbour town</h2>{BODY}<p>{MORE}</p><p>{BODY} {MORE}</p></div><p><a href=x>Back to top</a></p><p><a href=y>About us</a></p>"
    assert text(page) == "\n\n".join(["Storm in the harbour town", BODY, MORE, f"{BODY} {MORE}"])


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("   ", ""), ("<p></p>", ""), ("<article>a &lt; b && c &unknown; &am</article>", "a < b && c &unknown; &am"),
    ("<article>1 < 2 <3 <p", "1 < 2 <3"), ("<article>x<!-- never ended <p>y", "x"), ("<article>x<script>y</p>", "x"),
    ("<article>x</div></p></article><!doctype q>", "x"), ('<article title="a>b">x<p title=\'>\'>y</article>', "x\n\ny"),
    ("<ARTICLE>x<P>Y</ARTICLE>", "x\n\nY"), ("<article><h1>t</h1>a<![CDATA[b]]>c</?></ >", "t\n\nac"),
    ("<article>a<br><br/>b \n c</article>", "a b c"), ('<article>a <a href="x>b', "a b"),
])
def test_broken_and_odd_markup(page, want):
    assert text(page) == want


def test_long_and_deep_pages_take_linear_time():
    assert text("<article>" + "<div>" * 50_000 + "x" + "</p>" * 50_000) == "x"
    assert text("<article>" + "<b x='" * 20_000) == ""
    assert text("<article>" + "<" * 100_000).count("<") == 100_000
    long = "<article>" + "".join(f"<p>{BODY} {i}" for i in range(5000))
    assert text(long).count("\n\n") == 4999


def made_page(rng):
    """A page of a random layout, and its article's blocks."""
    def say(low, high):
        return " ".join(rng.choice("sun moon river stone light hill road tree bird wind house glass".split()) for _ in range(rng.randint(low, high))) + "."

    blocks = [("h1", say(3, 9))] + [("p", say(1, 6) if rng.random() < 0.15 else say(25, 120)) for _ in range(rng.randint(2, 12))]
    named = rng.random() < 0.7
    around = rng.choice(["article", "main", 'div class="post-content"', 'div id="article"', 'section role="main"']) if named else "div"
    links = "".join(f"<li><a href=/{i}>{say(1, 3)}</a></li>" for i in range(rng.randint(3, 9)))
    tops = [f"<nav><ul>{links}</ul></nav>", f'<div class="menu"><ul>{links}</ul></div>', f"<header><h2>{say(1, 4)}</h2><ul>{links}</ul></header>"]
    ends = [f"<footer><p>{say(5, 30)}</p></footer>", f'<div id="footer">{say(4, 20)}</div>', f"<ul>{links}</ul>"]
    sides = [f"<aside><h3>{say(1, 4)}</h3><p>{say(20, 60)}</p></aside>", f'<div class="sidebar widget"><p>{say(10, 70)}</p></div>',
             f'<div class="ad">{say(5, 25)}</div>', f"<form><p>{say(5, 25)}</p><input name=q></form>",
             f'<section class="comments"><p>{say(10, 60)}</p><p>{say(3, 40)}</p></section>', f'<p class="cookie-notice">{say(10, 40)}</p>']
    body = "".join(f"<{t}>{x}</{t}>" for t, x in blocks)
    inner = rng.choice(sides) if named and rng.random() < 0.4 else ""
    page = rng.choice(tops) + rng.choice(sides) + f"<{around}>{body}{inner}</{around.split()[0]}>" + "".join(rng.sample(sides, rng.randint(0, 3))) + rng.choice(ends)
    return f"<!doctype html><html><head><title>x</title></head><body>{page}</body></html>", [x for _, x in blocks]


def test_unseen_layouts():
    rng = random.Random(5)
    hit = found = wanted = 0
    for _ in range(400):
        page, blocks = made_page(rng)
        got = text(page).split("\n\n")
        size = lambda some: sum(len(x.split()) for x in some)
        hit, found, wanted = hit + size(x for x in got if x in blocks), found + size(got), wanted + size(blocks)
    assert hit / found > 0.97
    assert hit / wanted > 0.99


def test_frames_keep_rows_and_ignore_other_columns(spark):
    rows = [(1, "u", "<article>One &amp; two</article>", "x", 5), (1, "u", "<article>One &amp; two</article>", "x", 5), (None, None, None, None, None), (2, "v", "", "t", 1), (3, "w", "<nav>a</nav>", None, 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(2)
    got = sorted((tuple(r) for r in mt.extract(df).collect()), key=str)
    assert got == sorted([(1, "u", "One & two", 9), (1, "u", "One & two", 9), (None, None, "", 0), (2, "v", "", 0), (3, "w", "", 0)], key=str)
    assert mt.extract(df.limit(0)).collect() == []
