"""Pages without an article element, names that mislead, and long attributes, with the texts expected of them."""

import time

import pytest

from courtside.llm.html_text import main_text

STORY = " ".join(f"Sentence {k} tells what happened on the river that day and why the boats stayed." for k in range(12))
OTHER = "A short note of two lines stands here as well."
MENU = "<ul class='menu'>" + "".join(f"<li><a href='/{k}'>Section {k}</a></li>" for k in range(9)) + "</ul>"
NAMES = ["related work", "popular-science", "post tags-inside", "entry form-wide", "content share-enabled", "story legal", "page widget", "story search", "notice", "site banner-top", "ad-free reading", "side by side"]


def paragraphs(text):
    half = len(text) // 2
    cut = text.index(". ", half) + 1
    return f"<p>{text[:cut]}</p><p>{text[cut + 1 :]}</p>"


@pytest.mark.parametrize("name", NAMES)
def test_a_name_does_not_outweigh_the_text(name):
    got = main_text(f"<html><body>{MENU}<div class='{name}'>{paragraphs(STORY)}</div><div class='box'><p>{OTHER}</p></div></body></html>")
    assert STORY in got and "Section 3" not in got


@pytest.mark.parametrize("name", ["menu", "sidebar", "newsletter signup", "cookie-notice", "related-posts", "footer"])
def test_a_name_still_marks_what_is_short(name):
    got = main_text(f"<html><body><div class='text'>{paragraphs(STORY)}</div><div class='{name}'><p>{OTHER}</p></div></body></html>")
    assert got == STORY


@pytest.mark.parametrize("name", ["comments", "comment-list", "disqus"])
def test_comments_go_however_long(name):
    much = " ".join(f"Reader {k} says that this was to be expected by all." for k in range(80))
    got = main_text(f"<html><body><div class='text'>{paragraphs(STORY)}</div><div class='{name}'><p>{much}</p></div></body></html>")
    assert got == STORY
    hidden = main_text(f"<html><body><div class='text'>{paragraphs(STORY)}</div><div hidden><p>{much}</p></div></body></html>")
    assert hidden == STORY


@pytest.mark.parametrize("size", [10, 60_000, 70_000, 1_000_000])
def test_quoted_attributes_of_any_length(size):
    start = time.time()
    for attribute in (f'alt="a > b {"x" * size}"', f"alt = 'a > b {'x' * size}'", f'src="data:image/svg+xml,<svg>{"y" * size}</svg>">after'.replace(">after", "")):
        assert main_text(f"<body><div><p>{STORY}</p><img {attribute}><p>{OTHER}</p></div></body>") == f"{STORY} {OTHER}"
    assert time.time() - start < 5


def test_quotes_that_open_nothing():
    assert main_text(f"<body><p title=it's>{STORY}</p><p>{OTHER} It's so.</p></body>") == f"{STORY} {OTHER} It's so."
    assert STORY in main_text(f'<body><p title="open>{STORY}</p></body>')
    start = time.time()
    assert main_text('<p a="' * 50_000 + STORY) is not None
    assert time.time() - start < 10
