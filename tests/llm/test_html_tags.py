"""Tags that must not take an article with them."""

import time

import pytest

from assaymill.llm.html_extract import blocks, extract

ARTICLE = "<article><p>First words of it.</p><p>Then more.</p></article>"


@pytest.mark.parametrize(
    "tag",
    ["<svg-icon name=x>", "<object-view>", "<svg/>", '<svg viewBox="0 0 1 1"/>', "<math/>", "<svg>", "<svg><path d=x>", "<svg><title/><path/></svg>", "<svg><style /></svg>", "<svg>label<text>icon</text></svg>", "<svg><g><span>", "<noscript>", "<canvas>", "<object>", "<template>", "<math>", "<iframe src=x>", "<xmp>"],
)
def test_article_stays(tag):
    got = [b.text for b in blocks(f"<body><header>{tag}</header>{ARTICLE}<footer><svg><title>t</title></svg></footer></body>")]
    assert got == ["First words of it.", "Then more."]
    assert [b.text for b in blocks(f"<body>{tag}{ARTICLE}")] == got


def test_formulas_and_fallbacks_are_text():
    page = "<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p><noscript><p>No script.</p></noscript><template><p>Later.</p></template>"
    assert [b.text for b in blocks(page)] == ["Let x=2 hold.", "No script.", "Later."]


def test_raw_text_is_dropped():
    assert [b.text for b in blocks("<title>t</title><p>a</p><script src=x>if (a<b) {}</script ><style>p{}</style><svg><text>s</text></svg><p>b</p><script>c <p>d</p>")] == ["a", "b"]


@pytest.mark.parametrize(
    ("page", "found"),
    [("<script " * 131_072, 1), ("<a " * 349_525, 1), ("<div>x" * 100_000, 100_000), ("<b>" * 300_000 + "<p>x" * 1000, 1000), ("<a '>x" * 170_000, None), ("<a \"x><b' " * 100_000, None), ("<div>" * 100_000 + "</x>" * 200_000, 0),
     ("<script>" + "</script " * 100_000, 0), ("<p><b>x" * 150_000, 150_000)],
    ids=range(9),
)
def test_a_megabyte_of_broken_markup(page, found):
    """Time in proportion to the page: twice the half, about."""
    began = time.process_time()
    blocks(page[: len(page) // 2])
    half = time.process_time() - began
    began = time.process_time()
    got = blocks(page)
    assert time.process_time() - began <= 4 * half + 1
    assert found is None or len(got) == found


def test_odd_tables(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "<p" * 50_000, "x"), (3, "<p" * 50_000, "x"), (None, "<article><p>Some words of a story, told at length.</p></article>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = extract(pages).collect()
    assert sorted((r.page_id or 0) for r in got) == [0, 1, 2, 3, 3] and {r.text for r in got if r.page_id in (1, 2)} == {""} and all(r.n_chars == len(r.text) for r in got)
    assert extract(pages.where("false")).count() == 0
