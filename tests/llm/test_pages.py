"""Main texts of generated pages whose articles are known, with and without semantic tags, and markup as browsers cut it."""

import time

import numpy as np
import pytest

from quillfen.llm import pages


def blocks(source):
    return [text for _, text in pages.Page(source).blocks]


def page(draw, semantic):
    """(html, article): menus, notices and comments around a heading and paragraphs in an article element or a div."""

    def words(low, high):
        return " ".join(f"{draw.choice(['ta', 'lo', 'mer', 'sin', 'qua'])}{draw.choice(['re', 'ndo', 'st', 'vil'])}" for _ in range(draw.integers(low, high)))

    parts = [words(3, 9)] + [words(30, 120) + "." for _ in range(draw.integers(3, 9))]
    body = f"<h1>{parts[0]}</h1>" + "".join(f"<p>{p}</p>" for p in parts[1:])
    menu = "<ul>" + "".join(f'<li><a href="/{k}">{words(1, 3)}</a></li>' for k in range(draw.integers(3, 8))) + "</ul>"
    menu = f"<nav>{menu}</nav>" if semantic else f'<div class="menu">{menu}</div>'
    notice = f'<div class="{draw.choice(["cookie-notice", "ad", "newsletter"])}"><p>{words(5, 20)}</p></div>'
    comments = f'<div class="comments"><div class="comment"><p>{words(10, 40)}</p></div></div>'
    foot = f"<footer><p>{words(4, 12)}</p></footer>" if semantic else f'<div id="footer"><p>{words(4, 12)}</p></div>'
    holder = ("article", "") if semantic else ("div", draw.choice(["", 'class="content"', 'id="main"', 'class="entry"']))
    return f"<html><body>{menu}{notice}<{holder[0]} {holder[1]}>{body}</{holder[0]}>{comments}{foot}</body></html>", "\n".join(parts)


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 1.0])
def test_articles_are_found_whatever_holds_them(share):
    draw = np.random.default_rng(7)
    made = [page(draw, k < share * 100) for k in range(100)]
    order = draw.permutation(100)
    model = pages.train([made[k][0] for k in order[:60]])
    for own in (True, False):  # pages of a kind that no page of the sample has are read as well
        fresh = [page(draw, own) for _ in range(40)]
        found = pages.main_texts(model, [html for html, _ in fresh])
        same = hit = 0
        for text, (_, article) in zip(found, fresh, strict=True):
            same += sum(len(line) for line in set(text.split("\n")) & set(article.split("\n")))
            hit += len(text.replace("\n", ""))
        whole = sum(len(article.replace("\n", "")) for _, article in fresh)
        assert same >= 0.95 * whole and same >= 0.95 * hit, (share, own, same / whole, same / max(hit, 1))


def test_quotes_delimit_only_after_an_equals_sign():
    assert blocks('<p>one <img alt="12" monitor" src="x.png"> two</p>') == ["one two"]
    assert blocks("<p>a <b it's so</p><p>second</p><p>Don't</p>") == ["a", "second", "Don't"]
    assert blocks("<p title='a > b'>x</p><p title=\"it's > y\">z</p><p title=a'b>w</p>") == ["x", "z", "w"]
    assert blocks("<p>5 < 6 and 7 > 3 <3</p>") == ["5 < 6 and 7 > 3 <3"]
    assert pages.attribute_tokens(""" data-class="ad" alt='class="nav"' class=post id = "mainText" """) == ["post", "main", "text"]


def test_comments_end_as_in_browsers():
    assert blocks("<p>a<!-->b<!--->c<!-- d --!>e<!-- <p> -- > -->f</p>") == ["abcef"]
    assert blocks("<p>a</p><!-- open <p>b</p>") == ["a"]
    assert blocks("<p>a<? x ?>b</ >c<!doctype y>d</p>") == ["abcd"]
    assert blocks('<p>a</p><p title="never closed>b</p>') == ["a"]
    assert blocks("<p>a</p><script>x</script foo><p>b</p>") == ["a", "b"]


def test_time_grows_with_the_length_of_a_page():
    hostile = ["<", '<p a="', "<a ", "<a b=", "<!-", "</", "<!--", "<a\t", "</script x", "<a =", "<a '"]
    start = time.time()
    for piece in hostile:
        pages.Page(f"<p>x{piece * (1_000_000 // len(piece))}")
    pages.Page("<div>" * 40_000 + "</p></section>" * 40_000 + "<li>a</li>" * 40_000)
    assert time.time() - start < 60
    assert blocks("<p>x" + "<" * 5_000_000) == ["x" + "<" * 5_000_000]


def test_odd_pages_have_defined_texts(spark):
    html = "<body><article><p>one two three four five</p></article></body>"
    rows = [(1, "u", html), (1, "u", html), (2, None, None), (3, "v", ""), (None, "w", "<nav><a>x</a></nav>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = sorted(((r.page_id or 0, r.text, r.n_chars) for r in pages.extracted(frame).collect()))
    assert found[0][0] == 0 and [f[0] for f in found] == [0, 1, 1, 2, 3]
    assert found[1] == found[2] and found[3][1:] == ("", 0) and found[4][1:] == ("", 0)
    assert pages.extracted(frame.limit(0)).count() == 0
    assert pages.extracted(frame.withColumn("text", frame.url).withColumn("n_chars", frame.url)).count() == 5
