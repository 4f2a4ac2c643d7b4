"""HTML extraction on layouts that no training page has, and on hostile pages."""

import random
import time

import pytest

from gridscore.llm import html_extract


def prose(rng, lo=12, hi=50):
    w = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(lo, hi))]
    return (" ".join(w) + ".").capitalize()


def links(rng, n, sep):
    return sep.join(f'<a href="/{k}">{prose(rng, 1, 2)[:-1]}</a>' for k in range(n))


def layout(name, rng):
    """(page, main texts)."""
    main = ["A title " + prose(rng, 2, 5)[:-1], *[prose(rng) for _ in range(rng.randint(3, 8))]]
    body = f"<h1>{main[0]}</h1>" + "".join(f"<p>{x}</p>" for x in main[1:])
    menu, said = links(rng, 6, " | "), [prose(rng, 4, 20) for _ in range(3)]
    if name == "list comments":
        page = f'<div class="topbar">{menu}</div><div class="post">{body}</div><ol class="commentlist">' + "".join(f'<li id="c{k}"><p>{x}</p></li>' for k, x in enumerate(said)) + "</ol><footer>&copy; us</footer>"
    elif name == "table page":
        page = f"<table><tr><td class=menu>{links(rng, 6, '<br>')}</td><td>{body}</td></tr></table>"
    elif name == "no article":
        page = f'<div id="masthead">{menu}</div><div id="page"><div class="primary">{body}</div><div class="secondary"><h3>Also</h3><ul><li>{links(rng, 5, "</li><li>")}</li></ul></div></div>'
    elif name == "thread":
        page = f'<nav>{menu}</nav><main>{body}</main><section id="comment-thread"><h2>Comments</h2>' + "".join(f'<article class="comment"><p>{x}</p></article>' for x in said) + "</section>"
    else:
        page = f'<header><div class="brandbox">Site</div><ul class="linklist"><li>{links(rng, 6, "</li><li>")}</li></ul></header><section class="entry">{body}</section><div class="cookiebar"><p>{prose(rng, 6, 12)}</p><button>OK</button></div><div class="adslot">{prose(rng, 3, 9)}</div>'
    return f"<html><head><title>x</title></head><body>{page}</body></html>", main


@pytest.mark.parametrize("name", ["list comments", "table page", "no article", "thread", "compound names"])
def test_held_out_layouts(name):
    field, parser, rng = html_extract.fit(), html_extract.Parser(), random.Random(name)
    hit = found = wanted = 0
    for _ in range(40):
        page, main = layout(name, rng)
        blocks = parser.blocks(page)
        got = [t for (t, _, _), s in zip(blocks, field.decode(blocks)) if s]
        hit += len(set(got) & set(main))
        found += len(got)
        wanted += len(main)
    assert hit >= 0.9 * wanted and hit >= 0.9 * found, (hit / wanted, hit / found)


@pytest.mark.parametrize("page", ["<div>{}</section>", "<svg>", "<!", "<span>{}<p>", "<p", "<table><tr><td>", "<a href='", "<ul><li>x"])
def test_hostile_pages_take_linear_time(page):
    """Pages of about a megabyte within some seconds."""
    first, _, second = page.partition("{}")
    n = 1_000_000 // max(len(first) + len(second), 1) // 2
    began = time.process_time()
    html_extract.Parser().blocks(first * n + second * n)
    assert time.process_time() - began < 10
