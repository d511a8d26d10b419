"""Pages of any depth, notices inside articles, and tags with odd quotes."""

import random
import re
import time

import pytest

from meetspark.llm.html_text import content, parse, tag_end, tokens

TEXT = "The river rose in spring, and the farmers, who had waited, moved their sheep to the hills."
P = f"<p>{TEXT}</p>"


@pytest.mark.parametrize("depth", [1, 200, 300, 3_000, 30_000])
def test_furniture_is_seen_at_any_depth(depth):
    assert content("<div>" * depth + "<nav>Home menu About</nav>" + P + "</div>" * depth) == TEXT
    assert content("<b>" * depth + "<nav>Home menu About</nav>" + P) == TEXT


@pytest.mark.parametrize("name", ["notice", "notices", "alert", "disclaimer", "copyright", "replies", "respond", "site-notice", "alert-box"])
def test_notices_and_replies_in_an_article_go(name):
    note = f"<div class='{name}'><p>We use files, and so on, to make this work, as you know, dear reader.</p></div>"
    assert content(f"<html><body><article>{note}{P}{P}{P}{note}</article></body></html>") == "\n".join([TEXT] * 3)
    # an article of that name stays
    assert content(f"<body><article class='{name}'>{P}{P}</article></body>") == f"{TEXT}\n{TEXT}"


def plain_end(page, start):
    """Walks character by character: the first ``>`` outside quotes, or -1."""
    quote = None
    for i in range(start, len(page)):
        c = page[i]
        if quote:
            quote = None if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == ">":
            return i
    return -1


def test_tag_ends_equal_a_plain_walk():
    rng = random.Random(4)
    for _ in range(3_000):
        page = "".join(rng.choice(["<a ", ">", '"', "'", "x", "<p>", " b="]) for _ in range(rng.randint(1, 25)))
        dead = set()
        for m in re.finditer("<[ap]", page):
            first = page.find(">", m.start())
            if first >= 0:
                assert tag_end(page, m.end(), first, dead) == plain_end(page, m.end()), page


def test_odd_quotes_take_linear_time():
    for unit in ('<a "', "<a \"<a '", "<p class='x>a</p>", '<p title="a>b">x</p>', "<a b=\"><a c='>"):
        took = []
        for n in (4_000, 40_000):
            began = time.time()
            list(tokens(unit * n + ">"))
            took.append(time.time() - began)
        assert took[1] < 40 * took[0] + 0.5, unit


def test_implied_ends_stop_at_scopes():
    tags = lambda page: [(t, p) for t, p in zip(parse(page).tag, parse(page).parent, strict=True)][1:]
    assert tags("<ul><li>a<li>b</ul>") == [("ul", 0), ("li", 1), ("li", 1)]
    assert tags("<ul><li>a<ul><li>b</ul><li>c</ul>") == [("ul", 0), ("li", 1), ("ul", 2), ("li", 3), ("li", 1)]
    assert tags("<p>a<div>b") == [("p", 0), ("div", 0)]
    assert tags("<p><table><b><li>x") == [("p", 0), ("table", 0), ("b", 2), ("li", 3)]
