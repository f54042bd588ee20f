"""Tables with spans in both directions against a plain grid, and pages whose layout must stay in proportion."""

from __future__ import annotations

import random

import pytest

from cairnbook.llm.html_layout import extract_pages, extract_text


def plain(rows):
    """The same table on a grid of taken places: rows of (word, colspan, rowspan)."""
    taken, cells = set(), []
    for y, row in enumerate(rows):
        x = 0
        for word, wide, down in row:
            while any((y, x + d) in taken for d in range(wide)):
                x += 1
            cells.append((y, x, word, wide))
            taken |= {(y + b, x + a) for a in range(wide) for b in range(down)}
            x += wide
    widths = {}
    for _, x, word, wide in cells:
        if wide == 1:
            widths[x] = max(widths.get(x, 0), len(word))
    lines = []
    for y in range(len(rows)):
        line = ""
        for at, x, word, _ in cells:
            if at == y:
                line = (line + "  " if line else "").ljust(sum(widths.get(k, 0) + 2 for k in range(x))) + word
        lines.append(line.rstrip())
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines)


@pytest.mark.parametrize("seed", range(60))
def test_spans_against_a_grid(seed):
    rng = random.Random(seed)
    rows = [[(f"w{rng.randrange(10 ** rng.randint(1, 5))}", rng.choice((1, 1, 1, 2, 3)), rng.choice((1, 1, 1, 2, 4))) for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(1, 6))]
    html = "<table>" + "".join("<tr>" + "".join(f"<td colspan={w} rowspan={d}>{t}" for t, w, d in row) for row in rows) + "</table>"
    assert extract_text(html) == plain(rows)


@pytest.mark.parametrize("html", ["<blockquote>x" * 50_000, "<ul><li>y" * 30_000, "<table>" + "<tr><td colspan=1000>a<td>b" * 3000 + "</table>", "<table>" + "<tr><td rowspan=60000>a<td>b" * 300 + "</table>"])
def test_output_stays_in_proportion(html):
    out = extract_text(html)
    assert len(out) < 14 * len(html)
    for c in "xyab":
        assert out.count(c) == html.replace("table", "").replace("blockquote", "").replace("rowspan", "").replace("colspan", "").count(c)


def test_ruby_parentheses_are_not_shown():
    assert extract_text("<ruby>a<rp>(</rp><rt>b</rt><rp>)</rp></ruby>") == "ab"


def test_null_pages_repeated_rows_and_clashing_names(spark):
    rows = [(1, None, "t"), (1, None, "t"), (None, "", "t"), (2, "<p>a<p>b", "t")]
    got = extract_pages(spark.createDataFrame(rows, "page_id int, html string, text string")).collect()
    assert sorted(((r["page_id"], r["text"]) for r in got), key=str) == sorted([(1, ""), (1, ""), (None, ""), (2, "a\n\nb")], key=str)
