"""Renderers and names."""

import json

import pytest

from lodestar.operators import render

A = render.Answer("What <is> it?", "First.\n\n```\ncode\n\nmore\n```\n\n" + "x" * 900, ["concepts/a"], "2025-01-15T00:00:00Z")


def test_formats():
    assert "[[concepts/a]]" in render.render(A, "markdown")
    assert "<is>" not in render.render(A, "html")
    assert json.loads(render.render(A, "jupyter"))["cells"][0]["source"] == ["# What <is> it?"]
    compile(render.render(A, "chart"), "chart", "exec")
    slides = render.render(A, "marp").split("\n\n---\n\n")
    assert any("code\n\nmore" in s for s in slides)
    with pytest.raises(ValueError):
        render.render(A, "pdf")
    with pytest.raises(ValueError):
        render.Answer("q", "x" * 500_001)


def test_names():
    assert render.file_name(A, "html") == "2025-01-15-what-is-it.html"
    assert render.free_name("a", {"a", "a-2"}) == "a-3" and render.safe_name("CON") == "con-file"
