"""What stands apart stays out however long it is, and broken tags lose no text."""

import random

import pytest

from kinfold.llm import html_text

STORY = "".join(f"<p>Sentence number {i} of the story is told here at some length.</p>" for i in range(4))
TOLD = "\n".join(f"Sentence number {i} of the story is told here at some length." for i in range(4))
COMMENT = "<div class='comment'><p>Reader {} says at length what they think of it all, again and again.</p></div>"


@pytest.fixture(scope="module")
def weights(spark):
    pages, docs = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("pages", "documents"))
    return html_text.fit(html_text.known_text(pages, docs))


@pytest.mark.parametrize("apart", [
    "<div id='comments'>{comments}</div>", "<section class='comments'>{comments}</section>", "<footer>{links}</footer>", "<nav>{links}</nav>", "<aside class='sidebar'>{comments}</aside>",
    "<div class='cookie-notice'>{comments}</div>", "<div class='newsletter'>{comments}</div>", "<form class='signup'>{comments}</form>",
])
@pytest.mark.parametrize("box", ["<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>"])
def test_what_stands_apart_may_be_longer_than_the_text(weights, apart, box):
    if "<form" in apart and "div" in box:
        pytest.skip("a form may be the box of a page without an article")
    long = apart.format(comments="".join(COMMENT.format(i) for i in range(20)), links="".join(f"<p><a href='/{i}'>A link to another page {i}</a></p>" for i in range(60)))
    for page in (box.format(STORY) + long, long + box.format(STORY)):
        assert html_text.extract(f"<html><body>{page}</body></html>", weights) == TOLD


def test_boxes_around_all_of_a_page(weights):
    for page in (f"<form id='page-form'><div>{STORY}</div><footer>Imprint</footer></form>", f"<div class='sidebar-layout has-sidebar'><article>{STORY}</article></div>", f"<div class='comments-page'>{STORY}</div>", f"<div class='comments-enabled post'>{STORY}</div><div class='footer'>{'Terms and more terms. ' * 30}</div>"):
        assert html_text.extract(f"<body>{page}</body>", weights) == TOLD


def test_stray_quotes_lose_nothing(weights):
    page = "<article><p>First words <a title='it's fine'>a link</a> of the story here.</p><p>They don't stop at all and it isn't over.</p><p data-x=\"1\"2\">Nor \"here\" in the last part.</p></article>"
    assert html_text.extract(page, weights) == "First words a link of the story here.\nThey don't stop at all and it isn't over.\nNor \"here\" in the last part."
    page = "<article><p class=it's>Some words of it, a > b.</p><p title='a > b' id=\"x'y\">More words of it.</p><p a=''>Last words of it.</p></article>"
    assert html_text.extract(page, weights) == "Some words of it, a > b.\nMore words of it.\nLast words of it."


def test_quotes_that_never_end_cost_one_pass(weights):
    page = "<article>" + "<a title='x\" href=\"y>link</a> word " * 20_000
    html_text.extract(page, weights)
    html_text.extract("<a b=\"" * 50_000, weights)
    html_text.extract("<a b='" * 50_000 + ">", weights)


def test_any_ratio_of_text_and_comments(weights):
    rng = random.Random(5)
    for _ in range(200):
        n, m = rng.randrange(1, 12), rng.randrange(0, 40)
        told = [f"Part {i} tells what was seen there and why it is of note." for i in range(n)]
        comments = "".join(COMMENT.format(i) for i in range(m))
        frame = rng.choice(["<header class='site-header'><a>Our site</a></header>{a}{c}<footer>{c}</footer>", "<nav>{c}</nav><div class='page'>{a}</div><div id='disqus'>{c}</div>", "<div class='wrap'>{a}<section id='comments' class='comments-open'>{c}</section></div>"])
        box = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div class='post'>{}</div>"])
        page = frame.format(a=box.format("".join(f"<p>{x}</p>" for x in told)), c=comments)
        assert html_text.extract(f"<html><body>{page}</body></html>", weights) == "\n".join(told)
