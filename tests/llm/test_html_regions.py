"""Pages whose text stands in several containers: no block of it is dropped."""

import pytest

from planewise.llm import htmltext

A = "The first part of this text goes on for quite a while, as texts do."
B = "The second part is longer than the first one, " * 6 + "and ends here."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<div id=content><h1>Title</h1><div class=body><p>{B}</p><p>{A}</p></div></div>", f"Title {B} {A}"),
        (f"<body><nav>menu</nav><div id=c><div class=lead><p>{A}</p></div><div class=text><p>{B}</p></div></div><footer>f</footer>", f"{A} {B}"),
        (f"<table><tr><td><p>{A}</p></td><td><p>{B}</p></td></tr></table>", f"{A} {B}"),
        (f"<section><p>{A}</p></section><section><p>{B}</p></section><section><p>{B}</p></section>", f"{A} {B} {B}"),
        (f"<div id=content><h1>Title</h1><p>By X</p><div class=body><p>{B}</p></div></div><div class=sidebar><h2>Ads</h2><p>{A}</p></div>", f"Title By X {B}"),
        (f"<div><a href=x>Home</a> <a href=y>News and more</a></div><div class=a><h1><a href=z>Title</a></h1></div><div class=b><p>{B}</p><p>{B}</p></div><div class=c><p>End.</p></div>", f"Title {B} {B} End."),
        (f"<article><p>{B}</p></article><article><h2>Short</h2><p>note</p></article>", f"{B} Short note"),
    ],
)
def test_no_block_is_dropped(html, text):
    assert htmltext.extract(html) == text


def test_article_without_dense_text_does_not_displace_the_page():
    assert B in htmltext.extract(f"<div><div id=c><p>{B}</p></div><article><p>x</p></article></div>")
