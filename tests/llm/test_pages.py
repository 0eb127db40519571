"""Pages of layouts written by hand, and broken pages."""

import itertools
import random
import time

import numpy as np
import pytest

from lodestar.llm import html_extract

WORDS = "the river council voted on a new bridge after long debate because residents asked for safer crossings while engineers warned that cost could rise if steel prices climb again next year still most members agreed it was time to act and work will begin in spring with help from local firms who promised to hire apprentices".split()


@pytest.fixture(scope="module")
def crf():
    return html_extract.default_model()


def sentence(r, a=6, b=18):
    return " ".join(r.choice(WORDS) for _ in range(r.randint(a, b))).capitalize() + "."


def para(r):
    return " ".join(sentence(r) for _ in range(r.randint(2, 5)))


def title(r):
    return " ".join(r.choice(WORDS) for _ in range(r.randint(3, 7))).title()


def links(r, n):
    return "".join(f"<a href='/{r.choice(WORDS)}'>{r.choice(WORDS).title()}</a> " for _ in range(n))


def blog(r):
    t, ps = title(r), [para(r) for _ in range(4)]
    return f"<html><body><div id=top>{links(r, 6)}</div><div class='wrap'><h1>{t}</h1>" + "".join(f"<p>{p}</p>" for p in ps) + f"</div><div id='comments'><h4>3 comments</h4><div><b>Jo</b><p>{sentence(r)}</p></div></div><div class=footer>Copyright 2020 {r.choice(WORDS)}</div></body></html>", [t, *ps]


def divs(r):
    t, ps = title(r), [para(r) for _ in range(3)]
    return f"<html><body><div class='nav'><ul><li>{links(r, 1)}</li><li>{links(r, 1)}</li></ul></div><div class='c7'><h1>{t}</h1>" + "".join(f"<div class='txt'>{p}</div>" for p in ps) + f"</div><div class='sidebar'><h3>More</h3>{links(r, 4)}</div></body></html>", [t, *ps]


def news(r):
    t, ps = title(r), [para(r) for _ in range(5)]
    mid = "<div class='newsletter'><p>Sign up for our newsletter.</p><form><input><button>Go</button></form></div>"
    return f"<!doctype html><html><head><title>{t} | News</title></head><body><header><nav>{links(r, 8)}</nav></header><main><article><h1>{t}</h1><p>{ps[0]}</p>{mid}" + "".join(f"<p>{p}</p>" for p in ps[1:]) + f"</article><aside><h3>Most read</h3><ol><li>{links(r, 1)}</li></ol></aside></main><footer><p>{sentence(r)}</p></footer></body></html>", [t, *ps]


def table(r):
    t, ps = title(r), [para(r) for _ in range(3)]
    return f"<html><body><table><tr><td class=menu>{links(r, 7)}</td><td><h1>{t}</h1>" + "".join(f"<p>{p}</p>" for p in ps) + f"</td></tr></table><p class='legal'>{sentence(r)}</p></body></html>", [t, *ps]


def notice(r):
    t, ps = title(r), [para(r) for _ in range(3)]
    return f"<html><body><div class='cookie-banner'>We use cookies. <button>OK</button></div><div role=main><h1>{t}</h1>" + "".join(f"<p>{p}</p>" for p in ps) + f"<div class='share'>{links(r, 3)}</div></div><div class='ad'>{sentence(r)}</div></body></html>", [t, *ps]


def manual(r):
    t, ps = title(r), [para(r) for _ in range(4)]
    side = "".join(f"<li><a href=#s{i}>{title(r)}</a></li>" for i in range(4))
    return f"<html><body><nav class='navigation'><ul>{side}</ul></nav><main class='page'><h1>{t}</h1><p>{ps[0]}</p><h2>Setup</h2><p>{ps[1]}</p><p>{ps[2]}</p><h2>Use</h2><p>{ps[3]}</p></main><footer>Built by hand. <a href=/>Home</a></footer></body></html>", [t, ps[0], "Setup", ps[1], ps[2], "Use", ps[3]]


def letters(r):
    t, ps, quote = title(r), [para(r) for _ in range(3)], para(r)
    return f"<html><body><header class=site><p>The Daily</p>{links(r, 5)}</header><article class='story'><header><h1>{t}</h1></header><p>{ps[0]}</p><blockquote>{quote}</blockquote><p>{ps[1]}</p><ul><li>{ps[2]}</li></ul></article><section class='comments'><article><p>{sentence(r)}</p></article><article><p>{sentence(r)}</p></article></section></body></html>", [t, ps[0], quote, ps[1], ps[2]]


def bare(r):
    t, ps = title(r), [para(r), sentence(r, 3, 6), sentence(r, 2, 4)]
    return f"<html><body><h1>{t}</h1>" + "".join(f"<p>{p}</p>" for p in ps) + "</body></html>", [t, *ps]


def old(r):
    ps = [para(r) for _ in range(3)]
    return f"<html><head><title>{title(r)}</title></head><body bgcolor=white><center><font size=2>" + "<br>\n".join(ps) + "<br></font></center></body></html>", [" ".join(ps)]


def hosted(r):
    t, ps = title(r), [para(r) for _ in range(3)]
    return f"<html><body><div id=hd>{r.choice(WORDS).title()} {r.choice(WORDS).title()}</div><div id=main><h1>{t}</h1>" + "".join(f"<p>{p}</p>" for p in ps) + f"<button>Share</button></div><div id=disqus_thread><p>{sentence(r)}</p></div></body></html>", [t, *ps]


def answered(r):
    t, ps = title(r), [para(r) for _ in range(3)]
    return f"<html><body><div class=masthead>{links(r, 3)}</div><article><h1>{t}</h1>" + "".join(f"<p>{p}</p>" for p in ps) + f"</article><div class=responses><p>{sentence(r)}</p><p>{sentence(r)}</p></div></body></html>", [t, *ps]


@pytest.mark.parametrize("layout", [blog, divs, news, table, notice, manual, letters, bare, old, hosted, answered])
def test_layouts_by_hand(crf, layout):
    r, right = random.Random(11), []
    for _ in range(30):
        page, want = layout(r)
        right.append(html_extract.main_text(page, crf) == "\n".join(want))
    assert np.mean(right) >= 0.9


def test_best_labels_are_those_of_all_labelings():
    rng = np.random.default_rng(5)
    for n in [1, 2, 3, 7, 9]:
        for _ in range(20):
            e, trans = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
            worth = lambda y: sum(e[t, k] for t, k in enumerate(y)) + sum(trans[a, b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
            assert tuple(html_extract.viterbi(e, trans)) == max(itertools.product(range(2), repeat=n), key=worth)


def test_repeated_rows_and_long_pages(spark):
    page = "<h1>A title of this page</h1>" + "<p>A paragraph of some words, which says a thing. And another.</p>" * 20_000
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "v", "")]
    got = sorted((r["page_id"], r["n_chars"], len(r["text"].split("\n"))) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got[0] == got[1] and got[0][2] == 20_001 and got[2:] == [(2, 0, 1), (3, 0, 1)]


BROKEN = {
    "open elements": lambda n: "<div>x" * n,
    "open quotes": lambda n: '<div class="' * n,
    "lists below many elements": lambda n: "<ul>" + "<div>" * n + "<li></li>" * n,
    "paragraphs and bold": lambda n: "<b>x<p>" * n,
    "closing without opening": lambda n: "</div>" * n,
    "angle brackets": lambda n: "<" * n,
    "comments": lambda n: "<!--" * n,
    "scripts": lambda n: "<script>" * n,
}


@pytest.mark.parametrize("kind", sorted(BROKEN))
def test_a_broken_megabyte_takes_seconds(kind):
    one = len(BROKEN[kind](1000)) / 1000
    page = BROKEN[kind](int(1_000_000 / one))
    began = time.process_time()
    html_extract.features(html_extract.blocks(page))
    assert time.process_time() - began < 12  # linear; the square of it would be an hour


def test_blocks():
    shown = lambda page: [s for s, _, _ in html_extract.blocks(page)]
    assert shown("<script>if (a<b && c == \"x>y</p>\") {}</script><p title='a>b'>one</p>two<br>three") == ["one", "two three"]
    assert shown("<p>a<p>b<ul><li>c<li>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert shown("x < y <a href='open") == ["x < y <a href='open"] and shown("") == [] and shown("<!-- <p>no</p> --><p>&lt;yes&gt;</p>") == ["<yes>"]
    assert shown("<title>T</title><style>p{}</style><p>&nbsp; a \n b</p>") == ["a b"]
