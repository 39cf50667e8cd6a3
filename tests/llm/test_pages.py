"""Pages that the given ones don't show: links in the article, numbered marks, short blocks, no article or two."""

import pytest

from proofloom.llm import html_text

LONG = "long text of the story " * 6


@pytest.mark.parametrize(
    "page,text",
    [
        ("<article><h1><a>Title as link</a></h1><p>Text.</p></article>", "Title as link\nText."),
        ("<article><p>Text.</p><p><a>All of it a link.</a></p></article>", "Text.\nAll of it a link."),
        ("<article><p>One.</p>" + "".join(f"<p><a>link {i}</a></p>" for i in range(4)) + "<p>Two.</p></article>", "One.\nlink 0\nlink 1\nlink 2\nlink 3\nTwo."),
        (f"<p>Short one.</p><ul><li><a>a</a></li><li><a>b</a></li><li><a>c</a></li></ul><p>{LONG}</p>", f"Short one.\n{LONG.strip()}"),
        (f"<p>{LONG}</p><div><a>a</a></div><div><a>b</a></div><div><a>c</a></div><p>Last words.</p>", f"{LONG.strip()}\nLast words."),
        (f"<p>{LONG}</p><div><a>a</a></div><div><a>b</a></div><div><a>c</a></div><div>or</div><div><a>d</a></div><div><a>e</a></div>", LONG.strip()),
        ('<article><p>Text.</p><div id="comments-12"><p>Nice!</p></div><div class="ad-slot-3">Buy</div></article>', "Text."),
        ('<article><p class="chapter-12">Text.</p><p id="section-3">More.</p></article>', "Text.\nMore."),
        ("<article><p>First.</p></article><div>between</div><article><p>Second.</p></article>", "First.\nSecond."),
        ("<article><p>A.</p><ul><li>one item</li><li><a>x</a> and more</li></ul></article>", "A.\none item\nx and more"),
        ("<div><a>a</a></div><div><a>b</a></div>", ""),
        ("<p>a</p>", "a"),
    ],
)
def test_pages(page, text):
    assert html_text.main_text(page) == text
