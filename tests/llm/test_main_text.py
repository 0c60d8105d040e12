"""Main text of pages with several articles, columns, forms around everything and hidden parts."""

from __future__ import annotations

import random

import pytest

from auditloom.llm import markup


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)) + "."


SHAPES = {
    "articles in body": "<body><article>{a}</article><article>{b}</article></body>",
    "articles in main": "<body><main><article><p>{a}</p></article><article><p>{b}</p></article></main></body>",
    "article and section": "<body><main><article><p>{a}</p></article><section><p>{b}</p></section></main></body>",
    "boxes": "<body><div><p>{a}</p></div><div><p>{b}</p></div></body>",
    "columns": "<body><div id=row><div class=col><div><p>{a}</p></div></div><div class=col><div><p>{b}</p></div></div></div></body>",
    "form": "<body><form id=aspnetForm><div><p>{a}</p><p>{b}</p></div></form></body>",
    "hidden": "<body><div><p>{a}</p><p style='color: red; display : none'>gone</p><p>{b}</p><p style=\"visibility:hidden\">gone</p></div></body>",
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("sizes", [(12, 30), (30, 12), (60, 80), (400, 600)])
def test_no_part_is_lost(shape, sizes):
    rng = random.Random(f"{shape}{sizes}")
    a, b = (words(rng, n) for n in sizes)
    nav = "<nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav><div class=sidebar><p>Other things, said at some length, that are no article.</p></div>"
    page = SHAPES[shape].format(a=a, b=b).replace("<body>", f"<body>{nav}").replace("</body>", "<footer>Foot</footer></body>")
    assert markup.main_text(page) == f"{a} {b}"


def test_short_parts_beside_long_articles():
    rng = random.Random(2)
    long, short = words(rng, 600), words(rng, 10)
    assert markup.main_text(f"<body><article><p>{long}</p></article><article><p>{short}</p></article></body>") == f"{long} {short}"
    assert markup.main_text(f"<main><h1>Title</h1><article><p>{long}</p></article></main>") == f"Title {long}"
    links = "".join(f"<a href={i}>link {i} of many</a>" for i in range(9))
    assert markup.main_text(f"<body><article><p>{long}</p></article><section>{links}</section></body>") == long
    assert markup.main_text(f"<body><div><div><p>{long}</p></div></div><div><div>{links}</div></div></body>") == long


def slowly_gathered(page):
    """Texts of all paragraphs of a page in page order."""
    root = markup.tree(page)
    out = []

    def walk(x):
        for c in x.children:
            if not isinstance(c, str):
                out.append(" ".join("".join(t for t in c.children if isinstance(t, str)).split())) if c.tag == "p" else walk(c)

    walk(root)
    return " ".join(x for x in out if x)


def test_random_nests_of_alike_columns_keep_everything():
    rng = random.Random(3)

    def grown(depth):
        if depth == 0:
            return f"<p>{words(rng, 50)}</p><p>{words(rng, 40)}</p>"
        return "".join(f"<div>{grown(depth - 1)}</div>" for _ in range(rng.randint(1, 3)))

    for _ in range(60):
        page = f"<body>{grown(rng.randint(0, 4))}</body>"
        assert markup.main_text(page) == slowly_gathered(page)


def test_deep_pages_and_forms_to_fill_in():
    text = words(random.Random(4), 200)
    assert markup.main_text("<div>" * 20_000 + f"<p>{text}</p>") == text
    form = "<form><label>Name</label><input name=q><button>Send</button></form>"
    assert markup.main_text(f"<body><article><p>{text}</p></article>{form}</body>") == text
