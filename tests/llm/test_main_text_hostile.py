"""Pages of a megabyte that would take a parser with look-back hours: the time grows with their length."""

import time

import pytest

from tiersift.llm import dom

PAGES = {
    "no tag ends": "<b " * 350_000,
    "unknown ends": "<div>" * 60_000 + "</x>" * 60_000,
    "quotes": "<b '>' " * 100_000,
    "open formatting": "<b><div>" + "<i>" * 100_000 + "</b>" * 100_000,
    "items in a deep list": "<li><ul>" + "<div>" * 50_000 + "<li></li>" * 25_000,
    "open drawings": "<svg>" * 60_000,
    "open options": "<select>" + "<option>x" * 60_000,
    "open links": "<a>" * 100_000 + "<div></div>" * 25_000,
    "less-than signs": "<" * 1_000_000,
    "scripts": "<script></script" * 50_000,
}


@pytest.mark.parametrize("name", PAGES)
def test_hostile(name):
    model = dom.trained()
    start = time.process_time()
    model.extract([PAGES[name]])
    assert time.process_time() - start < 15


def test_deep_pages_keep_their_text():
    page = "<html><body><article>" + "<div>" * 5000 + "<p>A paragraph of the text that is long enough to count, surely.</p>" + "</div>" * 5000 + "</article></body></html>"
    assert dom.trained().extract([page]) == ["A paragraph of the text that is long enough to count, surely."]
    assert dom.parse("a < b <é> <p>c")[1] == [(0, "a < b <é>"), (1, "c")]
    assert dom.parse("<p>a<!-- x <p>b")[1] == [(1, "a")]
