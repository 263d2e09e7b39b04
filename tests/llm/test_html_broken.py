"""Markup of any kind ends no job, costs linear time and hides no article."""

import time

import pytest

from planewise.llm import htmltext

A = "The first part of this text goes on for quite a while, as texts do."
B = "The second part is longer than the first one, " * 6 + "and ends here."

SECTIONS = ["<![x[a]]>", "<![data[x]]>", "<![ if IE]>", "<![>", "<![1>", "<![CDATA[x]]>", "<![if !IE]>", "<![endif]>", "<!>", "<!->", "<!-->", "<!x y>", "<?x>", "</>", "</1>", "<!--x--!>", "&#" + "9" * 6000 + ";", "&#x" + "f" * 6000 + ";", "&#;", "<a b='", "<p =x>", "<\x00>"]


@pytest.mark.parametrize("odd", SECTIONS)
def test_odd_markup_before_an_article(odd):
    text = htmltext.extract(f"{odd}<article><h1>T</h1><p>{B}</p></article><p>x</p>" if odd != "<a b='" else f"<article><h1>T</h1><p>{B}</p></article>{odd}")
    assert f"T {B}" in text


@pytest.mark.parametrize("cut", ["<![", "<![1", "<![CDATA[", "<!", "<!-", "<!--", "<!-- x", "<", "</", "</p", "<p", "<p class='x", "<?", "&", "&#", "&am", "<script>x", "<style>", "<!doctype"])
def test_pages_cut_off(cut):
    assert B in htmltext.extract(f"<article><p>{B}</p></article>{cut}")


def test_a_bad_page_among_good_ones(spark):
    rows = [(k, "u", f"{odd}<article><p>{B}</p></article>{odd}") for k, odd in enumerate(SECTIONS)] + [(100, None, None), (101, "u", "<![")]
    got = {r["page_id"]: r["text"] for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and got[100] == "" and sum(B in t for t in got.values()) >= len(SECTIONS) - 1


@pytest.mark.parametrize("piece", ["<a ", "<div a='", '<div a="', "<!--", "<!-- >", "<![", "<!", "</", "</a", "<?", "<", "&", "&#", "<script>", "<a b=c ", "<a/", "--", "<!--->", "<p a=' >", "<x<", "</script", "<a \n", "-- "])
@pytest.mark.parametrize("before", ["", "<script>"])
def test_a_megabyte_of_broken_markup(piece, before):
    html = f"<article><p>{B}</p></article>{before}" + piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    htmltext.extract(html)
    htmltext.extract(html + ">")
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<html><head><title>t</title><meta charset=x><body><p>{B}</p></body></html>", B),
        (f"<head><title>t</title><link rel=x><div><p>{B}</p><p>{A}</p></div>", f"{B} {A}"),
        (f"<head><script>s</script>{B}", B),
        (f"<head><title>t<body><p>{B}</p>", B),
        (f"<html><head>\n<title>t</title>\n<template><p>{A}</p></template></head><body><p>{B}</p></body></html>", B),
        (f'<article class="post-comment"><p>{B}</p></article>', B),
        (f'<div id="comments"><p>{B}</p><p>{A}</p></div><nav><a href=x>m</a></nav>', f"{B} {A}"),
        (f'<article><p>{B}</p></article><div id="comments"><p>{B}</p><p>{A}</p><p>{B} {B}</p></div>', B),
    ],
)
def test_articles_are_found(html, text):
    assert htmltext.extract(html) == text
