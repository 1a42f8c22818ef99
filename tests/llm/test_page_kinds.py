"""Pages written by hand in layouts of many kinds, kinds left out of training, and pages that made the reader slow."""

import time

import pytest

from hearthgraph.llm import html_blocks

SENTENCES = [
    "The river rose for three days before the bridge gave way, and nobody in the valley slept.",
    "By the morning of the fourth day, the miller had moved his family to the church on the hill.",
    "Two carts and a boat were all that was left of the market, as the parish book records.",
]
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact</a></li></ul>'
FOOT = "<div>&copy; 2019 Valley News. All rights reserved.</div>"
A, B, C = SENTENCES

#: name, page, texts that the result must hold, texts that it must not hold
PAGES = [
    ("plain divs", f"<html><body><div>{MENU}</div><div><h1>The flood</h1><div>{A}</div><div>{B}</div><div>{C}</div></div>{FOOT}</body></html>", [A, B, C], ["News", "rights"]),
    ("wiki", f'<html><body><div id="mw-navigation">{MENU}</div><div id="content"><h1 id="firstHeading">The flood</h1><div id="mw-content-text"><p>{A}</p><h2>Causes</h2><p>{B}</p><p>{C}</p></div></div><div id="footer"><ul><li>Privacy policy</li></ul></div></body></html>', [A, B, C, "Causes"], ["Privacy", "Contact"]),
    ("terms", f"<html><body><nav>{MENU}</nav><h1>Words of the mill</h1><dl><dt>Race</dt><dd>{A}</dd><dt>Hopper</dt><dd>{B}</dd></dl>{FOOT}</body></html>", [A, B, "Race", "Hopper"], ["Contact"]),
    ("layout table", f'<html><body><table><tr><td colspan=2>Valley News</td></tr><tr><td width=150><a href="/">Home</a><br><a href="/n">News</a><br><a href="/x">Archive</a></td><td><h1>The flood</h1><p>{A}</p><p>{B}</p></td></tr><tr><td colspan=2>Copyright 2004 Valley News</td></tr></table></body></html>', [A, B], ["Archive", "Copyright"]),
    ("unnamed comments", f"<html><body><article><h1>The flood</h1><p>{A}</p><p>{B}</p></article><div><h3>2 comments</h3><div><b>Ann says:</b><p>What a story!</p><a href=#r>Reply</a></div><div><b>Joe 3 hours ago</b><p>Great read.</p><a href=#r>Reply</a></div></div></body></html>", [A, B], ["What a story", "Great read", "Reply"]),
    ("form", f"<html><body><article><h1>The flood</h1><p>{A}</p><form action=/q><p>Did you like this article about the flood?</p><input type=radio> Yes <button>Send</button></form><p>{B}</p></article></body></html>", [A, B], ["Did you like", "Send", "Yes"]),
    ("page in a form", f"<html><body><form id=page><div>{MENU}</div><div><h1>The flood</h1><p>{A}</p><p>{B}</p></div></form></body></html>", [A, B], ["Contact"]),
    ("figure and list", f"<html><body><nav>{MENU}</nav><article><h1>The flood</h1><p>{A}</p><figure><img src=a.png><figcaption>The bridge in 1893, seen from the mill.</figcaption></figure><ul><li>Two carts were lost.</li><li>One boat was found again.</li></ul><p>{B}</p></article></body></html>", [A, B, "The bridge in 1893", "Two carts were lost.", "One boat"], ["Contact"]),
    ("bare text", f"<html><body><h1>The flood</h1>{A}<br><br>{B}<br><br>{C}</body></html>", [A, B, C], []),
]


@pytest.mark.parametrize("name,page,holds,lacks", PAGES, ids=[p[0] for p in PAGES])
def test_pages_by_hand(name, page, holds, lacks):
    text = html_blocks.main_text(page, html_blocks.trained())
    assert [t for t in holds if t not in text] == []
    assert [t for t in lacks if t in text] == []


def test_kinds_left_out_of_training():
    """Precision and recall of blocks on kinds of layout that the labeller has not seen: 0.88 and 0.89 measured. Layout
    tables are the worst in precision (0.55 alone), lists of terms in recall (0.67 alone)."""
    left_out = ("divs", "terms", "figures", "layout_table")
    kinds = tuple(k for k in html_blocks.PageMaker.KINDS if k not in left_out)
    m = html_blocks.trained(kinds=kinds)
    hit = said = true = 0
    for k in range(9_000_000, 9_000_160):
        _, own, y = html_blocks.example(k, left_out)
        p = html_blocks.label(html_blocks.vectors([own]), m)[0] >= 0.5
        hit, said, true = hit + (p & (y >= 0.5)).sum(), said + p.sum(), true + (y >= 0.5).sum()
    assert hit / said > 0.85 and hit / true > 0.85


def test_densest_run_where_the_labeller_finds_nothing():
    own = html_blocks.blocks(f"<div>{MENU}<p>{A}</p><p>{B}</p>{MENU}</div>")
    assert html_blocks.chosen(own, html_blocks.np.zeros(len(own))) == [A, B]
    assert html_blocks.chosen(html_blocks.blocks(MENU), html_blocks.np.zeros(3)) == []


@pytest.mark.parametrize("piece", ["<b>x </i>", "<i><div><b>x</i>", "<div>x", "</p>x<div>", "<x-y><p>x", "<svg>x"])
def test_reading_is_linear(piece):
    seconds = []
    for n in (5_000, 40_000):
        start = time.process_time()
        own = html_blocks.blocks(piece * n)
        html_blocks.vectors([own])
        seconds.append(time.process_time() - start)
    assert seconds[1] < 8 * 3 * seconds[0] + 0.5
