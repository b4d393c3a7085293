import itertools
import random
import resource
import time

import pytest
from edges import CLASHES

from kermesse.llm.html import extract, main_text, minimum_cut


def test_the_cut_is_the_cheapest_labelling():
    draw = random.Random(2)
    for _ in range(300):
        n = draw.randint(1, 8)
        odds = [draw.uniform(-3, 3) for _ in range(n)]
        pairs = [(draw.randrange(n), draw.randrange(n), draw.random() * 2) for _ in range(draw.randint(0, 12))]
        edges = [e for e in pairs if e[0] != e[1]]

        def cost(kept):
            own = sum(max(0, -x) if keep else max(0, x) for keep, x in zip(kept, odds))
            return own + sum(w for a, b, w in edges if kept[a] != kept[b])

        best = min(cost(kept) for kept in itertools.product((False, True), repeat=n))
        assert cost(minimum_cut(odds, edges)) == pytest.approx(best)


SAID = "This is a paragraph about something, with words enough to be one, and it ends here."


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        (f"<nav><a href=x>Menu</a></nav><article><h1>T</h1><p>{SAID}</article><footer>&copy;</footer>", f"T {SAID}"),
        ("<article><p>a&nbsp;&amp; <b>b</b>c\n\n d<br>e &#233;</p></article>", "a & bc d e é"),
        (f"<article><p>{SAID}<script>x('</p>')</script><style>p{{}}</style><!-- no --></p></article>", SAID),
        (f"<main><p>{SAID}</p><form><label>Mail</label><input></form><aside>More</aside></main>", SAID),
        (f"<div class='cookie-notice'><p>We use cookies.</p></div><article><p>{SAID}</p></article>", SAID),
        (f"<article><p>{SAID}</p></article><section id=comments><p>{SAID}</p></section>", SAID),
        (f"<div><p>{SAID} {SAID}</p><p>Short.</p></div><div><a href=x>Imprint</a></div>", f"{SAID} {SAID} Short."),
        ("<article><ul><li>one<li>two</ul>loose</article>", "one two loose"),
        # A head that is not ended, a list that is not ended, a wrapper named after what it holds.
        (f"<html><head><title>x</title><body><article><p>{SAID}</article>", SAID),
        (f"<head><title>x</title><meta charset=x><article><p>{SAID}</article>", SAID),
        (f"<select><option>one<main><p>{SAID}</main>", SAID),
        (f"<div class='content-sidebar-wrap'><article><p>{SAID}</article><div class=sidebar>Ads</div></div>", SAID),
        (f"<div class='page has-sidebar'><p>{SAID} {SAID}</p></div><div class=sidebar><p>{SAID}</p></div>", f"{SAID} {SAID}"),
        (f"<form id=all><div class=sidebar><nav>Menu</nav></div><main><p>{SAID}</main></form>", SAID),
        (f"<div class='widget social'><article><p>{SAID} {SAID}</article></div><nav>Menu</nav>", f"{SAID} {SAID}"),
        (f"<div id=comments><article><p>{SAID} {SAID}</article></div><main><p>{SAID}</main>", SAID),
    ],
)
def test_pages(html, text):
    assert main_text(html) == text


def test_long_and_broken_pages():
    many = "".join(f"<p>{SAID} {i}</p>" for i in range(3000))
    assert main_text(f"<nav>x</nav><article>{many}").count(SAID) == 3000
    assert main_text("<article>" + "<div>" * 400 + "deep") == "deep"
    assert main_text("</p></b><article><b><p>x</b></article>") == "x"


@pytest.mark.parametrize(
    "page",
    [
        "<div>x " * 800_000, "<div class='a b'>" * 60_000, "<b>" * 200_000 + "</i>" * 60_000,
        "<i><div>" + "<b>x</i>" * 100_000, "<p><b>x" * 100_000, "<ul>" + "<li><i>x" * 100_000,
        "<div>" * 80_000 + "</section>" * 60_000, "<select><option>x" * 50_000,
    ],
)
def test_pages_of_open_elements(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 60  # quadratic time would be hours
    used = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert used < 6 << 20  # KB; whole paths would be tens of GB


def test_edges(spark):
    from pyspark.sql import functions as F

    rows = [(1, "u", "<article>a é</article>"), (2, None, None), (None, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = extract(pages.withColumns({name: F.lit("mine") for name in (*CLASHES, "text")}))
    assert sorted(((r.page_id, r.text, r.n_chars, r.arc) for r in out.collect()), key=repr) == sorted(
        [(1, "a é", 3, "mine"), (2, "", 0, "mine"), (None, "", 0, "mine")], key=repr
    )
    assert extract(pages.limit(0)).count() == 0
