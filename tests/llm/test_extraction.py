"""What the contract of the main text keeps and leaves out, on small pages."""

import collections
import re

import pytest

from evalweave.llm import extraction

PAGE = (
    "<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav>"
    "<article><h1>Head of it</h1><p>A paragraph number {0} with sentences. It is long enough, and it goes on.</p>"
    "<p>Another one of them, with a <a href=x>link</a> inside. Fine.</p></article>"
    '<aside><a href=y>More</a></aside><div class="comments"><p>A reader wrote this. It is long as well, you see.</p></div>'
    "<footer>All rights</footer></body></html>"
)


@pytest.fixture(scope="module")
def model():
    counts = collections.Counter()
    for i in range(200):
        extraction.count(counts, PAGE.format(i))
    return extraction.Model(counts)


KEPT = {
    "<p>One <img src=x> two</p>": "One two",
    "<article><p>two<wbr>three <input name=q> four</p></article>": "twothree four",
    "<article><p>above</p><hr><p>below</p></article>": "above\nbelow",
    "Just text, without any element. It is a page as well.": "Just text, without any element. It is a page as well.",
    "<body>Text right in the body. It has sentences.</body>": "Text right in the body. It has sentences.",
    "<article><p>a <button>b</button> <noscript>c</noscript> <math><mi>x</mi><mo>+</mo></math> "
    "<svg><text>s</text></svg></p></article>": "a b c x+\ns",
    "<article><p>pick <select><option>one</select> now</p><xmp><b>&amp;</xmp></article>": "pick one now\n<b>&amp;",
    '<article><p title="abc>inner text here</p><p>second.</p></article>': "inner text here\nsecond.",
    "<article><p class='it\"s' title=\"a>b\">Quoted.</p><script>no()</script><style>p{}</style></article>": "Quoted.",
    '<article><p>The main text of it. Long.</p></article><section class="comments"><article>'
    "<p>A comment, which is an article of its own. It is long.</p></article></section>": "The main text of it. Long.",
}


@pytest.mark.parametrize("page", KEPT)
def test_text_of_a_page(model, page):
    assert model.text(page) == KEPT[page]


def test_pages_without_tags_and_names_of_content(model):
    """The model tells content from the rest where no article or main says so."""
    page = PAGE.format(7)
    want = model.text(page)
    assert want.startswith("Head of it\nA paragraph number 7") and "reader" not in want and "More" not in want
    assert model.text(re.sub("<(/?)article", r"<\1div", page)) == want


def test_very_long_and_repeated_pages(spark):
    """Rows are told apart, whatever repeats in them; a long page is read to its end."""
    long = "<article>" + "".join(f"<p>Paragraph {i} of it. It goes on.</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "u", long, "x"), (1, "u", long, "x"), (2, None, PAGE.format(2), "y"), (None, "v", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extraction.extract(pages, extraction.train(pages)).collect()
    assert sorted(r.n_chars for r in got if r.page_id == 1) == [len(r.text) for r in got if r.page_id == 1]
    assert all(r.text.count("\n") == 19_999 for r in got if r.page_id == 1)
    assert [r.text for r in got if r.page_id is None] == [""] and len(got) == 4


def test_all_counts_are_used(spark):
    """Rare tags count as well, however many there are."""
    rows = [(i, "u", f"<article><x{i}><p>Some text number {i}. Of it.</p></x{i}></article>") for i in range(1500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    model = extraction.train(pages)
    assert sum(what.startswith("tag x") for _, what, _ in model.counts) == 1500
