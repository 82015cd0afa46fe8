"""Elements that are left open take nothing of the article after them."""

import pytest

from tiersift.llm import dom

ARTICLE = "<article><h1>A title of the page</h1><p>First paragraph of the text, which is long enough to count.</p><p>Second one of the text, also long enough to count.</p></article>"
TEXT = "A title of the page\nFirst paragraph of the text, which is long enough to count.\nSecond one of the text, also long enough to count."


@pytest.mark.parametrize("before", ["<datalist id=b><option value=A><option value=B></datalist>", "<div><noscript></div>", "<div><button></div>", "<div><svg></div>", "<div><object></div>", "<div><canvas></div>", "<select><option>A<option>B</select>", "<noscript>Enable scripts</noscript>"])
@pytest.mark.parametrize("after", ["", "<footer><button>x</button><select><option>y</option></select></footer>"])
def test_open_tags(before, after):
    assert dom.trained().extract([f"<html><body>{before}{ARTICLE}{after}</body></html>"]) == [TEXT]


def test_objects_of_an_article_stay():
    page = ARTICLE.replace("also long", "also <math><mi>x</mi></math> long")
    assert dom.trained().extract([f"<html><body>{page}</body></html>"]) == [TEXT.replace("also long", "also x long")]
