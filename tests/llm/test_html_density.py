"""Density selects the regions, names only weigh; hostile pages take linear time."""

import time

import numpy as np
import pytest

from planewise.llm import htmltext

A = "The first part of this text goes on for quite a while, as texts do."
B = "The second part is longer than the first one, " * 6 + "and ends here."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f'<article class="post has-sidebar"><h1>T</h1><p>{B}</p><div class="sidebar"><p>{A}</p></div></article>', f"T {B}"),
        (f'<div class="content related-wrap"><p>{B}</p><p>x</p></div><div class="related"><p>{A}</p></div>', f"{B} x"),
        (f'<div class="page-header-fixed"><div class="nav">a b</div><p>{B}</p><p>{A}</p></div>', f"{B} {A}"),
        (f'<form action="/"><div class=menu>m</div><div><p>{B}</p><p>{A}</p></div><input></form>', f"{B} {A}"),
        (f"<form><p>Your name, please, and your city of birth</p></form><p>{B}</p>", B),
        (f'<div class="post comments-open"><p>{B}</p><div class="comments"><p>{B} {B}</p></div></div>', B),
        (f'<div><div class="entry"><h2>T</h2><p>{B}</p></div><div class="trending"><p>{A}</p></div><div class="recommended"><p>{A}</p></div></div>', f"T {B}"),
    ],
)
def test_names_only_weigh(html, text):
    assert htmltext.extract(html) == text


# No article, no class, no element that tells: a list of short lines far from the text, and the text.
_SHORT = "".join(f"<div><span>Item {k}</span><i>new</i></div>" for k in range(12))
_MIXED = f"<body>{_SHORT}<div><p>{B}</p></div><div><p>Short.</p></div><div><p>{B}</p></div><div><p>{A}</p></div>{_SHORT}</body>"


def test_density_and_smoothing_decide(monkeypatch):
    """The text between dense lines is kept and what is far from them isn't; without smoothing or clusters that fails."""
    want = f"{B} Short. {B} {A}"
    assert want in htmltext.extract(_MIXED) and "Item 5" not in htmltext.extract(_MIXED)
    monkeypatch.setattr(htmltext, "smoothed", lambda r: np.ones(len(r)))
    assert "Item 5" in htmltext.extract(_MIXED)
    monkeypatch.setattr(htmltext, "smoothed", lambda r: r)
    assert "Short." not in htmltext.extract(_MIXED.replace("<p>Short.</p>", "<p><b>S</b><i>h</i><b>o</b><i>r</i><b>t</b><i>.</i></p>"))


@pytest.mark.parametrize(
    "html",
    [
        "<div>" * 100_000 + B + "</div>" * 100_000,
        "<b>" * 100_000 + B + "</i>" * 100_000,
        "<i>" + "<p><b>" * 50_000 + B + "</i>" * 50_000,
        "<h1>" * 50_000 + f"<p>{B}" * 2_000,
        f"<div class=sidebar-x><p>{B}</p>" * 20_000,
        f"<p>{B}</p>" * 40_000,
    ],
)
def test_hostile_pages_take_linear_time(html):
    began = time.perf_counter()
    assert B in htmltext.extract(html)
    assert time.perf_counter() - began < 20
