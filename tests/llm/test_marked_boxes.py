"""Pages whose article lies in elements that their names or tags mark."""

import time

import pytest

from gleanframe.llm import html

PROSE = ["This is the first paragraph of the article, long enough to count, and it has commas.",
         "The second paragraph goes on, says a little more, and comes to an end."]
BODY = "".join(f"<p>{p}</p>" for p in PROSE)
SIDE = "<div class='sidebar'><p>Something else to read, a teaser.</p></div>"


@pytest.mark.parametrize("page", [
    f"<body><div class='layout has-sidebar'><h1>Title</h1>{BODY}{SIDE}</div></body>",
    f"<body><div id='page' class='no-sidebar'><div><h1>Title</h1>{BODY}</div>{SIDE}</div></body>",
    f"<body>{SIDE}<section class='widget-article'><h1>Title</h1>{BODY}</section></body>",
    f"<body><div><div class='post-header'><h1>Title</h1></div><div class='content'>{BODY}</div>{SIDE}</div></body>",
    f"<body><div class='content'><div class='post-header'><h1>Title</h1><a>Share</a></div>{BODY}</div></body>",
    f"<body><form id='aspnetForm'><input><div><h1>Title</h1>{BODY}</div>{SIDE}<button>Go</button></form></body>",
    f"<body><form><fieldset><div class='page-with-menu'><h1>Title</h1>{BODY}{SIDE}</div></fieldset></form></body>",
])
def test_article_in_a_marked_box(page):
    assert html.main_text(page) == "\n".join(["Title", *PROSE])


def test_boxes_beside_an_article_stay_out():
    comments = "<div class='comments'>" + "<p>A comment, not so short, on what is said above.</p>" * 6 + "</div>"
    form = "<form class='newsletter'><p>Subscribe to our letter, it costs nothing.</p></form>"
    hidden = f"<div style='display:none'>{BODY * 5}</div>"
    page = f"<body><div class='content'><h1>Title</h1>{BODY}</div>{comments}{form}{hidden}</body>"
    assert html.main_text(page) == "\n".join(["Title", *PROSE])
    assert html.main_text(f"<p>{PROSE[0]} <span class='ad'>Buy</span>now</p>") == f"{PROSE[0]} now"


def test_deep_marked_boxes_take_linear_time():
    start = time.monotonic()
    assert html.main_text("<div class='widget'>" * 50_000 + BODY) == "\n".join(PROSE)
    assert time.monotonic() - start < 20
