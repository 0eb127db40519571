"""Answers as files: Markdown, slides, HTML, a chart script, a notebook. One row of a result, rendered on the driver."""

from __future__ import annotations

import html
import json
import re
from dataclasses import dataclass, field

#: Most characters of an answer; characters of a slide; names that file systems reserve.
LONGEST, SLIDE = 500_000, 800
RESERVED = {"con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))}


@dataclass
class Answer:
    question: str
    text: str
    sources: list[str] = field(default_factory=list)
    at: str = ""

    def __post_init__(self):
        if len(self.text) > LONGEST:
            raise ValueError(f"an answer has at most {LONGEST} characters")


def safe_name(text: str, longest: int = 80) -> str:
    s = re.sub(r"-{2,}", "-", re.sub(r"[^\w-]+", "-", text.lower())).strip("-")[:longest].rstrip("-") or "untitled"
    return f"{s}-file" if s in RESERVED else s


def free_name(base: str, taken: set[str], longest: int = 80) -> str:
    """base, or base-n for the first free n from 2; base is trimmed so that the whole fits."""
    name, n = base[:longest].rstrip("-"), 2
    while name in taken:
        tail = f"-{n}"
        name, n = base[: longest - len(tail)].rstrip("-") + tail, n + 1
    return name


def header(a: Answer) -> str:
    lines = ["---", f"question: {json.dumps(a.question, ensure_ascii=False)}", f"created: {json.dumps(a.at)}", "sources:"]
    return "\n".join([*lines, *(f"  - {json.dumps(s, ensure_ascii=False)}" for s in a.sources), "---", ""])


def markdown(a: Answer) -> str:
    return f"{header(a)}\n# {a.question}\n\n{a.text}\n\n## Sources\n\n" + "\n".join(f"- [[{s}]]" for s in a.sources) + "\n"


def slides(a: Answer) -> str:
    """Paragraphs gathered into slides of about SLIDE characters; fenced code stays whole."""
    parts, now, fenced = [], [], False
    for block in re.split(r"\n\n+", a.text):
        if now and not fenced and sum(map(len, now)) + len(block) > SLIDE:
            parts.append("\n\n".join(now))
            now = []
        now.append(block)
        fenced ^= block.count("```") % 2 == 1
    parts.append("\n\n".join(now))
    return f"---\nmarp: true\n---\n\n# {a.question}\n\n---\n\n" + "\n\n---\n\n".join(parts) + "\n"


def page(a: Answer) -> str:
    e = html.escape
    body = "".join(f"<p>{e(p)}</p>" for p in re.split(r"\n\n+", a.text))
    return f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{e(a.question)}</title></head><body><h1>{e(a.question)}</h1>{body}<ul>" + "".join(f"<li>{e(s)}</li>" for s in a.sources) + "</ul></body></html>"


def chart(a: Answer) -> str:
    """A script that draws how often each source is named."""
    counts = {s: a.text.count(s) for s in a.sources}
    return f"import json\nimport matplotlib.pyplot as plt\n\ncounts = json.loads({json.dumps(json.dumps(counts))})\nplt.barh(list(counts), list(counts.values()))\nplt.title({json.dumps(a.question)})\nplt.tight_layout()\nplt.savefig('chart.png')\n"


def notebook(a: Answer) -> str:
    cell = lambda s: {"cell_type": "markdown", "metadata": {}, "source": s.splitlines(keepends=True)}
    return json.dumps({"nbformat": 4, "nbformat_minor": 5, "metadata": {}, "cells": [cell(f"# {a.question}"), cell(a.text), cell("\n".join(f"- {s}" for s in a.sources))]}, ensure_ascii=False)


FORMATS = {"markdown": (markdown, "md"), "marp": (slides, "md"), "html": (page, "html"), "chart": (chart, "py"), "jupyter": (notebook, "ipynb")}


def render(a: Answer, kind: str) -> str:
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; known: {', '.join(FORMATS)}")
    return FORMATS[kind][0](a)


def file_name(a: Answer, kind: str, taken: set[str] = frozenset()) -> str:
    stem = free_name(f"{a.at[:10]}-{safe_name(a.question)}".strip("-"), set(taken), 100)
    return f"{stem}.{FORMATS[kind][1]}"


def cite(sources: list[tuple[str, str]], mode: str = "markdown") -> str:
    """A section of sources from (kind, path) pairs, each path once: "markdown", "marp" (the same) or "html"."""
    if mode not in ("markdown", "marp", "html"):
        raise ValueError(f"unknown mode {mode!r}; known: html, markdown, marp")
    first = {path: kind for kind, path in reversed(sources)}
    pairs = [(first[p], p) for p in dict.fromkeys(p for _, p in sources)]
    if not pairs:
        return ""
    if mode == "html":
        shown = [(k, html.escape(p, quote=True)) for k, p in pairs]
        items = [f'<a href="./wiki/{p}.md">{p}</a>' if k == "wiki" else f"<code>{p}</code>" for k, p in shown]
        return "\n".join(['<ul class="sources">', *(f"  <li>{i}</li>" for i in items), "</ul>"])
    return "\n".join(["\n---\n**Sources:**\n", *(f"- [[{p}]]" if k == "wiki" else f"- `{p}`" for k, p in pairs)])
