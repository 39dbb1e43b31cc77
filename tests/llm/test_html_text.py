import numpy as np
import pytest
from quarry.llm.html_text import extract, main_text, smoothed

LONG = "This sentence is long enough to be the text of an article, as anyone can see. " * 3
WANT = LONG.strip()
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">More</a></li></ul></nav>'


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("   <!-- only --> ", ""),
        ("plain text only", "plain text only"),
        (f"<html><head><title>T</title><style>p{{}}</style></head><body>{NAV}<article><h1>Title</h1><p>{LONG}<p>Short.</p></article><footer>&copy; us</footer>", f"Title\n{WANT}\nShort."),
        (f"<body><header><p>{LONG}</p></header><main><h2>A</h2><p>x&amp;y &lt;b&gt; &#233;&nbsp;z\n\t q</p><p>{LONG}</p></main><aside>{LONG}</aside></body>", f"A\nx&y <b> é z q\n{WANT}"),
        (f'<div class="ad">{LONG}</div><article><p><b>{LONG}<br><p>Two<br>lines</article>', f"{WANT}\nTwo lines"),
        (f'<body><div id="cookie-notice"><p>{LONG}</p></div><div class="content"><h1>T</h1><p>{LONG}</p><p>End.</p></div><div class="sidebar"><p>{LONG}</p></div></body>', f"T\n{WANT}\nEnd."),
        (f'<article><p>{LONG}</p><section class="comments"><p>{LONG}</p></section><form><p>{LONG}</p></form></article>', WANT),
        (f'<article><script>var a = "</p><p>no";</script><p>{LONG}</p><style>b</style></article>', WANT),
        (f"<article><p>{LONG}</p></article><div class='comments'><article class='comment'><p>{LONG}</p></article></div>", WANT),
        (f"<article><p>{LONG}</p></article><article><p>{LONG}2</p></article>", f"{WANT}\n{LONG}2"),
        (f"<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><p>{LONG}</p></article>", f"one\ntwo\na\nb\n{WANT}"),
        ("<article><p>Be.</p></article>" + NAV, "Be."),
        (f"<![CDATA[x]]><![if IE]><article><p>{LONG}", WANT),
        (f"<nav><p>never closed<div><article><p>{LONG}</p></article></div>", ""),
        ("<p>" + "x " * 400_000 + "</p>", ("x " * 400_000).strip()),
    ],
)
def test_pages(html, text):
    assert main_text(html) == text
    assert main_text(html, step=7 if len(html or "") < 5000 else 1 << 16) == text


@pytest.mark.parametrize("tag", ["section", "blockquote", "div", "table><tr><td"])
def test_text_around_an_inner_region_stays(tag):
    inner = "".join(f"<p>{LONG}{k}</p>" for k in range(8))
    end = "</td></tr></table>" if "td" in tag else f"</{tag}>"
    want = ["T", WANT, *(f"{LONG}{k}" for k in range(8)), f"{LONG}last"]
    assert main_text(f"<body>{NAV}<div class=post><h1>T</h1><p>{LONG}</p><{tag}>{inner}{end}<p>{LONG}last</p></div><footer>us</footer></body>").split("\n") == want


def test_unequal_articles_stay():
    long = "".join(f"<p>{LONG}{k}</p>" for k in range(8))
    want = [*(f"{LONG}{k}" for k in range(8)), "Two", WANT]
    assert main_text(f"<body>{NAV}<article>{long}</article><article><h2>Two</h2><p>{LONG}</p></article></body>").split("\n") == want
    assert main_text(f"<body><main>{long}</main><article><h2>Two</h2><p>{LONG}</p></article></body>").split("\n") == want


def test_smoothing_keeps_a_level():
    assert np.allclose(smoothed(np.full(7, 3.0)), 3.0)
    a = smoothed(np.array([0.0, 0, 9, 0, 0]))
    assert a.argmax() == 2 and a[1] == a[3] > a[0]


def test_frames(spark, sf):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>"), (2, None, None), (None, "u", ""), (1, "u", f"<article><p>{LONG}</p></article>")]
    df = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = extract(df).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(1, "u", WANT, len(WANT))] * 2 + [(2, None, "", 0), (None, "u", "", 0)], key=str)
    assert extract(df.limit(0)).collect() == []
    assert extract(spark.read.parquet(f"{sf}/pages.parquet")).where("n_chars > 0").count() == 50


LINKS = "".join(f"<li><a href=/{k}>Link number {k}</a></li>" for k in range(12))


@pytest.mark.parametrize("names", [("navbar", "content", "sidebar", "footer"), ("x1", "x2", "x3", "x4"), ("", "", "", "")])
def test_boilerplate_goes_whatever_its_name(names):
    a, b, c, d = (f"<div class='{n}'>" for n in names)
    page = f"<body>{a}<ul>{LINKS}</ul></div>{b}<h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>{c}<h3>About</h3><p>A small blog.</p></div>{d}<p>Copyright 2024 Example Inc.</p></div></body>"
    assert main_text(page) == f"Title\n{WANT}\nShort.\n{WANT}"
    wrapped = page.replace("<body>", "<body><div class=page>").replace("</body>", "</div></body>")
    assert main_text(wrapped) == f"Title\n{WANT}\nShort.\n{WANT}"


def test_names_are_only_hints_within_an_article():
    page = f"<article><h1>T</h1><p class='login-notice-explained'>{LONG}</p><div class=widget><p>{LONG}</p></div><div class=share><a href=/t>Send</a> <a href=/m>Mail</a></div><p id=newsletter>{LONG}</p></article>"
    assert main_text(page) == "\n".join(["T", WANT, WANT, WANT])
    assert main_text(f"<body class='widget page'><div class='widget'><h1>T</h1><p>{LONG}</p></div></body>") == f"T\n{WANT}"
    assert main_text(f"<article><p>{LONG}</p><div class='ad'><p>{LONG}</p></div><div id=comments><p>{LONG}</p></div></article>") == WANT


def planted(rng):
    """A page in one of several layouts, names drawn at random or left out, and its content lines."""
    words = "time people water number sound place year work back thing name sentence line cause mean before move right boy old same tell does set three want air well also play small end put home read hand port large spell add even land here must big high such follow act why ask men change went light kind off need house picture try".split()
    prose = lambda low, high: " ".join(rng.choices(words, k=rng.randint(low, high))).capitalize() + "."
    blocks, want = [], []
    want.append(prose(3, 8))
    blocks.append(f"<h1>{want[0]}</h1>")
    for _ in range(rng.randint(4, 14)):
        kind = rng.random()
        t = prose(2, 6) if kind < 0.15 else prose(20, 90)
        if kind > 0.9:
            items = [prose(4, 12) for _ in range(rng.randint(2, 4))]
            want += items
            blocks.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
            continue
        want.append(t)
        tag = "h2" if kind < 0.07 else "blockquote" if kind > 0.85 else "p"
        shown = f"{t[:10]}<b>{t[10:20]}</b>{t[20:]}" if rng.random() < 0.3 else t
        blocks.append(f"<{tag}>{shown}</{tag}>")
    if rng.random() < 0.4:  # the last part in a container of its own
        k = rng.randint(2, len(blocks) - 1)
        blocks[k:] = ["<div>" + "".join(blocks[k:]) + "</div>"]
    name = lambda *n: rng.choice([f' class="{rng.choice(n)}"', f' class="x{rng.randrange(99)}"', ""])
    menu = lambda: "<ul>" + "".join(f"<li><a href=/{w}>{w}</a></li>" for w in rng.choices(words, k=rng.randint(4, 15))) + "</ul>"
    top = f"<div{name('nav', 'menu', 'topbar')}>{menu()}</div>"
    if rng.random() < 0.5:
        top += f"<div{name('notice', 'cookie-bar')}><p>{prose(4, 9)}</p></div>"
    side = f"<div{name('sidebar', 'related')}><h3>{prose(1, 3)}</h3>{menu()}</div>" if rng.random() < 0.7 else ""
    foot = f"<div{name('footer', 'copyright')}><p>Copyright {rng.randint(1990, 2030)} {rng.choice(words)}</p></div>"
    body = "".join(blocks)
    layout = rng.randrange(4)
    middle = [f"<article>{body}</article>", f"<div{name('content', 'post')}>{body}</div>", f"<main>{body}</main>", f"<table><tr><td>{body}</td></tr></table>"][layout]
    inner = f"{middle}{side}" if rng.random() < 0.7 else f"{side}{middle}"
    page = f"{top}<div{name('wrap', 'page')}>{inner}</div>{foot}" if rng.random() < 0.5 else f"{top}{inner}{foot}"
    return f"<html><body>{page}</body></html>", want


def test_precision_and_recall_on_planted_pages():
    """Line by line, over pages most of whose boilerplate has no telling name."""
    import random

    rng, hit, got_n, want_n, exact = random.Random(4), 0, 0, 0, 0
    for _ in range(400):
        page, want = planted(rng)
        got = main_text(page).split("\n")
        common = sum(min(got.count(x), want.count(x)) for x in set(got))
        hit, got_n, want_n, exact = hit + common, got_n + len(got), want_n + len(want), exact + (got == want)
    print(hit / got_n, hit / want_n, exact / 400)
    assert hit / got_n > 0.97 and hit / want_n > 0.99 and exact > 320
