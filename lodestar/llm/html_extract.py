"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between the tags of block elements. A block's features
come from the tags and the class and id words of its ancestors and from its text; two labels, kept
or not, form a chain whose weights are learned from labelled pages by gradient steps on the
conditional likelihood, and Viterbi decoding picks the blocks of the article.
"""

from __future__ import annotations

import html as entities
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

#: Pages learned from, gradient steps, step size, weight decay.
PAGES, EPOCHS, STEP, DECAY = 900, 200, 0.1, 1e-4

#: Element names of HTML by what they do to the text.
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HIDDEN = set("script style noscript template svg math iframe object textarea select button title head".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noscript".split())
CLOSES_P = BLOCK - {"body", "html"}
TAGS = sorted(BLOCK | set("a b button em i label span strong".split()))
#: Words in class and id attributes that say what an element is for.
CUES = "ad ads advert advertisement article banner body breadcrumb breadcrumbs byline comment comments consent content cookie cookies crumbs disclaimer discussion disqus entry feedback footer form ft gdpr hd header legal login main masthead menu meta modal nav navbar navigation newsletter notice notification notifications paging pagination popup post promo promoted reader related reply replies respond response responses reviews search share sharing sidebar signup social sponsor sponsored story subscribe tags text thread toolbar topbar trackbacks widget".split()

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_UNTIL = re.compile("[>\"']")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_LISTS = {"li", "ul", "ol", "menu"}


class Element:
    """An open element: its tag, and what it and its ancestors say of a block inside."""

    __slots__ = ("tag", "marks", "own", "article", "mixed", "title", "_features")

    def __init__(self, tag: str, cues: tuple, parent: Element | None):
        self.tag, self._features = tag, None
        marks = parent.marks if parent else frozenset()
        new = {f"in:{tag}", *(f"cue:{c}" for c in cues)} & _INDEX.keys()
        self.marks = marks if new <= marks else marks | new
        self.own = tag if tag in BLOCK else parent.own if parent else None
        self.article = tag in ("article", "main") or bool(parent and parent.article)
        inside = parent is not None and "in:article" in parent.marks
        self.mixed = bool(parent and parent.mixed) or inside and tag in ("section", "aside", "form", "footer", "nav", "header")
        self.title = tag == "h1" or bool(parent and parent.title)

    def features(self) -> tuple:
        if self._features is None:
            f = set(self.marks)
            if self.own:
                f.add(f"own:{self.own}")
            if self.own == "p":
                f.add("parent_p")
            if not self.article:
                f.add("no_article")
            if self.mixed:
                f.add("article_then_section")
            self._features = tuple(sorted(_INDEX[x] for x in f if x in _INDEX))
        return self._features


def _tags(page: str, seek: list[int]):
    """(start, end, tag, whether it closes, attributes) of the tags of a page, in one pass from seek[0] on; comments and declarations have no tag.

    A quote in a tag reaches to its closing quote; where there is none, to the tag's end.
    """
    at, size, unclosed = 0, len(page), {}
    while (start := page.find("<", max(at, seek[0]))) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = size if end < 0 else end + 1
            yield start, at, "", False, ""
            continue
        m = _NAME.match(page, start + 1)
        if not m:
            at = start + 1
            continue
        at = m.end()
        while (stop := _UNTIL.search(page, at)) and stop[0] != ">":
            quote, at = stop[0], stop.end()
            end = -1 if unclosed.get(quote) else page.find(quote, at)
            if end < 0:
                unclosed[quote] = True
            else:
                at = end + 1
        if not stop:  # the page ends inside a tag
            return
        at = stop.end()
        closes = m[0][0] == "/"
        yield start, at, m[0].lstrip("/").lower(), closes, page[m.end() : at - 1]


def blocks(page: str) -> list[tuple[str, Element | None, int]]:
    """(text, innermost element, characters inside links) of the leaf blocks. Time is linear in the page."""
    out, stack, text, lists = [], [], [], []
    hidden = linked = links = 0
    open_: dict[str, int] = {}  # how many of a tag are open
    lower = None

    def flush():
        nonlocal links
        if text and (s := " ".join(entities.unescape("".join(text)).split())):
            out.append((s, stack[-1] if stack else None, links))
        text.clear()
        links = 0

    def pop(k):
        nonlocal hidden, linked
        for e in stack[k:]:
            hidden -= e.tag in HIDDEN
            linked -= e.tag == "a"
            open_[e.tag] -= 1
        del stack[k:]
        while lists and lists[-1] >= k:
            lists.pop()

    def place(tag):
        """Where the innermost open element of a tag is; what lies above it is popped by all who ask."""
        return next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None) if open_.get(tag) else None

    at, seek = 0, [0]
    for start, end, tag, closes, attributes in _tags(page, seek):
        if start > at and not hidden:
            part = page[at:start]
            text.append(part)
            links += linked and len(part)
        at = end
        if not tag:
            continue
        if closes:
            k = place(tag)
            if tag in BLOCK:
                flush()
            if k is not None:
                pop(k)
            continue
        if tag == "br":
            text.append("\n")
        if tag in CLOSES_P:
            flush()
            if (k := place("p")) is not None:
                pop(k)
            if tag == "li" and lists and stack[lists[-1]].tag == "li":
                pop(lists[-1])
        if tag == "body":
            k = next((i for i, e in enumerate(stack[:8]) if e.tag == "head"), None)
            if k is not None:
                pop(k)
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            lower = lower or page.lower()
            end = lower.find(f"</{tag}", at)
            at = seek[0] = len(page) if end < 0 else end
            continue
        cues = tuple(w for n in _NAMES.finditer(attributes) for w in _WORD.findall((n[1] or n[2] or n[3] or "").lower())) if attributes else ()
        if tag in _LISTS:
            lists.append(len(stack))
        stack.append(Element(tag, cues, stack[-1] if stack else None))
        open_[tag] = open_.get(tag, 0) + 1
        hidden += tag in HIDDEN
        linked += tag == "a"
    if at < len(page) and not hidden:
        text.append(page[at:])
    flush()
    return out


_TEXT = ["bias", "first", "last", "is_title", "ends_stop", "has_stop", "only_link", "mostly_link", "some_link", "words_1", "words_2", "words_5", "words_15", "words_40", "copyright", "parent_p", "no_article", "page_has_article", "article_then_section"]
_INDEX = {name: i for i, name in enumerate([*_TEXT, *(f"in:{t}" for t in TAGS), *(f"own:{t}" for t in TAGS), *(f"cue:{c}" for c in CUES)])}


def features(found: list[tuple[str, Element | None, int]]) -> list[list[int]]:
    title = next((s for s, e, _ in found if e and e.title), "")
    article = any(e and e.article for _, e, _ in found)
    out = []
    for i, (s, e, links) in enumerate(found):
        n, f = s.count(" ") + 1, ["bias"]
        f.append("words_1" if n < 2 else "words_2" if n < 5 else "words_5" if n < 15 else "words_15" if n < 40 else "words_40")
        if i == 0:
            f.append("first")
        if i == len(found) - 1:
            f.append("last")
        if s == title:
            f.append("is_title")
        if s[-1] in ".!?…\"”":
            f.append("ends_stop")
        if ". " in s:
            f.append("has_stop")
        if links:
            f.append("only_link" if links >= 0.9 * len(s) else "mostly_link" if links > 0.5 * len(s) else "some_link")
        if "©" in s or "copyright" in s.lower():
            f.append("copyright")
        if article:
            f.append("page_has_article")
        out.append([*(_INDEX[x] for x in f), *(e.features() if e else _BARE)])
    return out


#: Features of text outside all elements.
_BARE = (_INDEX["no_article"],)


def labelled_pages(n: int = PAGES, seed: int = 3) -> list[tuple[str, list[str]]]:
    """Invented pages of many layouts, with the blocks of their articles."""
    rng = random.Random(seed)
    syllables = [a + b for a in "b d f g k l m n p r s t v z th st".split() for b in "a e i o u en er ou".split()]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    some = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: some(1, 22).capitalize() + rng.choice([".", ".", ".", "!", "?", " |", "%%%", ""])
    para = lambda: " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 3, 6])))
    link = lambda: f'<a href="/{word()}">{some(1, 3)}</a>'
    pick = rng.choice

    def menu():
        tag, name = pick([("nav", ""), ("nav", ' class="menu"'), ("div", ' class="navbar"'), ("ul", ' id="menu"'), ("div", ' class="breadcrumb"'), ("div", ' role="navigation"'), ("div", f' id="{pick(["hd", "masthead", "topbar", "crumbs"])}"')])
        if rng.random() < 0.3:  # a row of links, or of their words alone
            return f"<{tag}{name}>" + pick([" ", " | "]).join(pick([link, lambda: some(1, 2).title()])() for _ in range(rng.randint(2, 6))) + f"</{tag}>"
        return f"<{tag}{name}><ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 9))) + f"</ul></{tag}>"

    def chaff():
        kind = rng.randrange(12)
        if kind == 0:
            return f'<div class="{pick(["ad", "ads", "advert", "banner", "sponsored", "promo"])}">{pick([sentence(), para(), f"<p>{para()}</p>"])}</div>'
        if kind == 1:
            return f'<aside{pick(["", " class=sidebar", " class=related"])}><h3>{some(1, 4)}</h3><ul>' + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(1, 5))) + f"</ul><p>{para()}</p></aside>"
        if kind == 2:
            return f'<form class="{pick(["search", "newsletter", "subscribe", "login"])}"><label>{some(1, 4)}</label><input name="q"><p>{sentence()}</p><button>{some(1, 2)}</button></form>'
        if kind == 3:
            return f'<div class="{pick(["cookie notice", "notice", "consent", "cookie-banner", "popup", "disclaimer"])}"><p>{para()}</p></div>'
        if kind == 4:
            return f'<div class="{pick(["share", "social", "sharing toolbar"])}">' + " ".join(link() for _ in range(3)) + "</div>"
        if kind == 5:
            return f'<div class="{pick(["sidebar", "widget", "related"])}"><h4>{some(1, 3)}</h4><p>{para()}</p>' + "".join(f"<p>{link()}</p>" for _ in range(rng.randint(0, 4))) + "</div>"
        if kind == 6:
            return menu()
        if kind == 7:
            return f'<section class="{pick(["newsletter", "promo", "related", "signup"])}"><h2>{some(1, 4)}</h2><p>{para()}</p></section>'
        if kind == 8:
            return f'<div{pick(["", f" id={word()}", f" class={word()}"])}>' + pick([" ", " | ", ""]).join(link() for _ in range(rng.randint(2, 9))) + "</div>"
        if kind == 9:
            return f'<div class="{pick(["newsletter", "subscribe", "signup", "promo", "related", "social", "feedback", "login"])}">{pick([f"<p>{sentence()}</p>", sentence(), f"<h4>{some(1, 4)}</h4><p>{para()}</p>"])}</div>'
        if kind == 10:
            return f'<{(t := pick(["p", "div", "section"]))} class="{pick(["legal", "disclaimer", "copyright", "footer", "meta", "byline", "tags"])}">{pick([sentence(), para(), link()])}</{t}>'
        return f'<p class="{pick(["ad", "notice", "promo", "sponsored"])}">{para()}</p>'

    def comments():
        tag, name = pick([("section", "comments"), ("div", "comments"), ("div", "comment-list"), ("ol", "commentlist comments"), ("section", "discussion"), ("div", "reader-comments"), ("ul", "replies"), ("div", "disqus_thread"), ("div", "responses"), ("div", "reviews"), ("section", "trackbacks")])
        inner = pick([lambda: f'<div class="comment"><p>{para()}</p></div>', lambda: f"<p>{para()}</p>", lambda: f'<article class="comment"><p>{para()}</p></article>', lambda: f'<li class="comment"><b>{word()}</b> <p>{para()}</p></li>', sentence, lambda: f"<div>{para()}</div>"])
        return f'<{tag} {pick(["class", "id"])}="{name}"><h3>{some(1, 3)}</h3>' + "".join(inner() for _ in range(rng.randint(1, 5))) + f"</{tag}>"

    def plain():
        lines = [pick([para(), sentence(), some(2, 6).capitalize() + "."]) for _ in range(rng.randint(1, 6))]
        head = [some(1, 8).capitalize()] if rng.random() < 0.6 else []
        open_, close = pick([("", ""), ("<center>", "</center>"), ("<center><font size=2>", "</font></center>"), ("<font face=arial>", "</font>"), ("<div align=center>", "</div>"), ("<div>", "</div>")])
        top = "".join(f"<h1>{t}</h1>" for t in head)
        if rng.random() < 0.5:
            inner, kept = pick(["<br>", "<br><br>\n"]).join(lines), [" ".join(" ".join(lines).split())]
        else:
            inner, kept = "".join(f"<p>{t}{pick(['</p>', ''])}" for t in lines), [" ".join(t.split()) for t in lines]
        return f"<html><head><title>{some(1, 5)}</title></head><body>{top}{open_}{inner}{close}</body></html>", head + kept

    pages = []
    for _ in range(n):
        kept, body = [], []
        if rng.random() < 0.12:  # a page of text and nothing else, in old markup or in paragraphs only
            pages.append(plain())
            continue
        paragraph = pick(["p"] * 6 + ["div", "div class=x1", "section", 'div class="txt"'])
        title = pick([some(2, 9).capitalize(), sentence()])
        open_, close = pick([("<article>", "</article>")] * 4 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main"><div class="post entry">', "</div></div>"), ('<div class="article-body">', "</div>"), ('<div class="story text">', "</div>"), ("<div>", "</div>"), ('<div class="txt">', "</div>"), (f'<div class="{word()}">', "</div>"), (f'<div id="{word()}"><div>', "</div></div>"), ("<table><tr><td>", "</td></tr></table>"), (f'<table><tr><td class={pick(["menu", "nav", "sidebar", word()])}>{" ".join(link() for _ in range(rng.randint(2, 8)))}</td><td>', "</td></tr></table>"), ("", "")])

        def add(tag, text):
            shown = text
            if rng.random() < 0.15:
                shown = shown.replace(" ", f" <a href='/x'>{(w := word())}</a> ", 1)
                text = text.replace(" ", f" {w} ", 1)
            if rng.random() < 0.1:
                shown, text = shown + " &amp; &#233;", text + " & é"
            end = tag.split()[0]
            body.append(pick([f"<{tag}>{shown}</{end}>"] * 5 + [f"<{tag}><b>{shown}<br>"] * (tag == "p")))
            kept.append(" ".join(text.split()))

        if rng.random() < 0.9:
            pick([lambda: add("h1", title), lambda: (body.append("<header>"), add("h1", title), body.append("</header>"))] if "article" in open_ else [lambda: add("h1", title)])()
        for _ in range(rng.choice([0, 1, 2, 4, 8, 15])):
            kind = rng.random()
            if kind < 0.62:
                add(paragraph, para())
            elif kind < 0.69:
                add(pick(["h2", "h3"]), some(1, 6).capitalize())
            elif kind < 0.74:
                add("blockquote", para())
            elif kind < 0.8:
                tag = pick(["ul", "ol"])
                body.append(f"<{tag}>")
                for _ in range(rng.randint(1, 4)):
                    add("li", pick([sentence(), some(1, 5)]))
                body.append(f"</{tag}>")
            elif kind < 0.83:
                body.append("<table><tr>")
                for _ in range(rng.randint(2, 6)):
                    add("td", some(1, 3))
                body.append("</tr></table>")
            elif kind < 0.86:
                body.append("<section>"), add("h2", some(1, 5)), add("p", para()), body.append("</section>")
            else:
                body.append(chaff())
        if rng.random() < 0.2:
            body.append(comments())
        before = [menu() for _ in range(pick([0, 1, 1, 1, 2]))] + [chaff() for _ in range(pick([0, 0, 1, 1, 2]))]
        if rng.random() < 0.4:
            before.insert(0, f'<{(t := pick(["header", "div class=header"]))}><p>{some(1, 4)}</p>{menu()}</{t.split()[0]}>')
        after = [chaff() for _ in range(pick([0, 0, 1, 2]))] + ([comments()] if rng.random() < 0.25 else [])
        if rng.random() < 0.85:
            after.append(f'<{(t := pick(["footer", "footer", "div class=footer", "div id=footer"]))}>{pick(["&copy; ", "Copyright ", "", ""])}{pick([some(1, 4) + ". " + sentence(), f"<p>{sentence()}</p>", "<ul><li>" + link() + "</li></ul>"])}</{t.split()[0]}>')
        page = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style></head><body>" + "".join(before) + open_ + "".join(body) + close + "".join(after)
        pages.append((page + pick(["</body></html>", ""]), kept))
    return pages


def learn(pages: list[tuple[str, list[str]]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features by label, and of label pairs (from start, between), from labelled pages."""
    rows, labels, lengths = [], [], []
    for page, kept in pages:
        found = blocks(page)
        if not found:
            continue
        rows += features(found)
        k = 0
        for s, _, _ in found:  # the article's blocks are in page order
            y = k < len(kept) and s == kept[k]
            k += y
            labels.append(int(y))
        lengths.append(len(found))
    x = np.zeros((len(rows), len(_INDEX)))
    for i, f in enumerate(rows):
        x[i, f] = 1
    y, lengths = np.array(labels), np.array(lengths)
    starts, most = np.cumsum(lengths) - lengths, lengths.max()
    at = starts[:, None] + np.minimum(np.arange(most), lengths[:, None] - 1)
    live = np.arange(most) < lengths[:, None]
    onehot = np.eye(2)[y]
    pairs = np.zeros((2, 2))
    for t in range(1, most):
        np.add.at(pairs, (y[at[live[:, t], t - 1]], y[at[live[:, t], t]]), 1)
    w, trans = np.zeros((len(_INDEX), 2)), np.zeros((2, 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)]
    for step in range(1, EPOCHS + 1):
        e = (x @ w)[at]  # pages x blocks x labels
        forward, scale = np.zeros_like(e), np.zeros(e.shape[:2])
        for t in range(most):
            a = e[:, t] if t == 0 else np.logaddexp.reduce(forward[:, t - 1, :, None] + trans, axis=1) + e[:, t]
            scale[:, t] = np.logaddexp.reduce(a, 1)
            forward[:, t] = a - scale[:, t, None]
        backward = np.zeros_like(e)
        joint = np.zeros((2, 2))
        for t in range(most - 2, -1, -1):
            b = trans + (e[:, t + 1] + backward[:, t + 1])[:, None, :]
            on = live[:, t + 1]
            p = forward[:, t, :, None] + b
            p = np.exp(p - p.max((1, 2), keepdims=True))
            joint += (p / p.sum((1, 2), keepdims=True))[on].sum(0)
            b = np.logaddexp.reduce(b, 2)
            backward[:, t] = np.where(on[:, None], b - b.max(1, keepdims=True), 0)
        post = forward + backward
        post = np.exp(post - np.logaddexp.reduce(post, 2)[:, :, None])
        p = np.zeros_like(onehot)
        p[at[live]] = post[live]
        grads = (x.T @ (onehot - p) / len(y) - DECAY * w, (pairs - joint) / len(y))
        for k, (value, grad) in enumerate(zip((w, trans), grads)):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            value += STEP * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w, trans


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best labels of one chain."""
    n = len(e)
    back = np.zeros((n, 2), np.int8)
    score = e[0]
    for t in range(1, n):
        both = score[:, None] + trans
        back[t] = both.argmax(0)
        score = both.max(0) + e[t]
    out = np.zeros(n, np.int8)
    out[-1] = score.argmax()
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def main_text(page: str, model: tuple[np.ndarray, np.ndarray]) -> str:
    found = blocks(page)
    if not found:
        return ""
    w, trans = model
    e = np.stack([w[f].sum(0) for f in features(found)])
    return "\n".join(s for (s, _, _), y in zip(found, viterbi(e, trans)) if y)


@lru_cache(1)
def default_model() -> tuple[np.ndarray, np.ndarray]:
    """Learned from PAGES invented pages; takes some seconds once on the driver."""
    return learn(labelled_pages())


def extract(pages: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None, html_col: str = "html") -> DataFrame:
    """pages with `text` and `n_chars` in place of the html column.

    The whole html is read; null or empty html, or a page without an article, gives an empty text.
    Input columns named text or n_chars, in any case, are replaced. Repeated rows give repeated
    results, and an empty table an empty result.
    """
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    small_batches(pages.sparkSession)
    others = [c for c in pages.columns if c.lower() not in ("text", "n_chars", html_col.lower())]
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches):
        for batch in batches:
            texts = [main_text(p or "", shared.value) for p in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*others, "text", "n_chars"])

    schema = StructType([*(pages.schema[c] for c in others), StructField("text", StringType()), StructField("n_chars", LongType())])
    return pages.select(*[f"`{c}`" for c in others], f"`{html_col}`").mapInArrow(run, schema)


def op9_html(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
