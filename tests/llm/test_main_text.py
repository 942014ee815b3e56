"""Main text of templates that name and nest things differently, page by page and by a host's consensus."""

import pytest

from tidemark.llm import htmltext

PROSE = " ".join(["A sentence of the article that is long enough to count as prose, really."] * 3)
PAR = f"<p>{PROSE}</p>"

#: Name: (body, text).
PAGES = {
    "a layout named after its sidebar": (f'<div class="sidebar-layout"><div class="post">{PAR}</div><div class="adbox">x</div></div>', PROSE),
    "an image of a header": (f'<div class="header-image-story">{PAR}</div>', PROSE),
    "comments of users": (f'<article><h1>Big</h1>{PAR}<div class="user-comments"><p>I like it very much, thanks.</p></div></article>', f"Big\n{PROSE}"),
    "a thread": (f'<article>{PAR}<section id="discussion-thread"><p>I like it.</p></section></article>', PROSE),
    "feedback": (f'<article>{PAR}<div class="feedback-notes"><p>I like it.</p></div></article>', PROSE),
    "a newsletter": (f'<article>{PAR}<div class="newsletter-cta">Sign up</div><p>End.</p></article>', f"{PROSE}\nEnd."),
    "an advert in a story": (f'<article>{PAR}<div class="story-ad-unit">Buy</div></article>', PROSE),
    "a comment by its type": (f'<article>{PAR}<div itemprop="comment"><p>No.</p></div><div itemscope itemtype="https://schema.org/Comment"><p>Yes.</p></div></article>', PROSE),
    "comments that outweigh the text": (f'<div class="post">{PAR}</div><div id="comments">{PAR * 5}</div>', PROSE),
    "a heading beside its text": (f'<main><h1>The big title</h1><div class="b">{PAR}</div></main>', f"The big title\n{PROSE}"),
    "a short second part": (f"<main><div>{PAR}</div><div>Kort.</div></main>", f"{PROSE}\nKort."),
    "two articles": (f"<article>{PAR}</article><article><p>Second</p>{PAR}</article>", f"{PROSE}\nSecond\n{PROSE}"),
    "a wrap of heading, text and last words": (f'<div class="wrap"><h1>Head</h1><div class="c">{PAR}</div><p>Last words.</p></div>', f"Head\n{PROSE}\nLast words."),
    "a form round the page": (f'<form id="aspnetForm"><div id="page">{PAR}</div></form><form class="search"><p>Search</p></form>', PROSE),
    "states of a page": (f'<div class="page has-ads with-sidebar">{PAR}</div>', PROSE),
    "teasers beside the article": (f'<main><h1>Head</h1><article>{PAR}</article><article><a href="/x">Another story of the day</a></article></main>', f"Head\n{PROSE}"),
    "a short related note": (f'<article>{PAR}<div class="related"><p>Short but text.</p></div></article>', f"{PROSE}\nShort but text."),
    "related links": (f'<article>{PAR}<div class="related"><a href="x">Short but a link.</a></div></article>', PROSE),
    "the discussion of a paper": (f'<article><section id="results">{PAR}</section><section id="discussion"><p>We discuss.</p></section></article>', f"{PROSE}\nWe discuss."),
    "a menu without a name": (f'<div><a href="/a">Home</a> <a href="/b">News</a></div><div>{PAR}<p>Short.</p></div>', f"{PROSE}\nShort."),
}


@pytest.mark.parametrize("name", PAGES)
def test_templates(name):
    body, want = PAGES[name]
    page = f"<html><head><title>t</title></head><body>{body}</body></html>"
    assert htmltext.extract(page) == want
    path, chars = htmltext.vote(page)
    assert htmltext.extract(page, path) == want and chars >= len(want.replace("\n", "")) - len("Second" + PROSE)


#: Frames of hosts, none of which names its parts; %s is the article's blocks.
FRAMES = {
    "plain": '<div class="x1"><p>Welcome to the site of all the news that we print here.</p></div><div class="x2">%s</div><div class="x3"><p>All rights are ours, and nothing may be copied.</p></div>',
    "table": "<table><tr><td>The paper of the town, every day since long ago.</td></tr><tr><td>%s</td></tr></table>",
    "nested": '<div id="a"><div><p>Read us every day, on paper and on screens.</p><div class="b">%s</div></div></div>',
    "list": '<ul class="q"><li>Our town, our paper, our news of the day.</li></ul><section>%s</section><div>Write to us at the old market square.</div>',
}


def test_blocks_that_a_host_repeats_are_its_frame(spark):
    rows, want = [], {}
    for h, frame in enumerate(FRAMES.values()):
        for k in range(8):
            i = 100 * h + k
            parts = [f"Title {h} of {k}", f"{PROSE} Number {k} of {h}.", f"Short {k}."]
            rows.append((i, f"http://host{h}.example/{k}", f"<html><body>{frame % ''.join(f'<p>{x}</p>' for x in parts)}</body></html>"))
            want[i] = "\n".join(parts)
    # A host whose pages are one article again and again keeps it, and so does one with few pages.
    rows += [(1000 + k, "http://copies.example/", f"<body><div>{PAR}</div><p>{k}</p></body>") for k in range(9)]
    rows += [(2000 + k, "http://few.example/", f"<body><div><p>Same here.</p><p>{PROSE} {k}</p></div></body>") for k in range(3)]
    # In an article nothing goes because it is repeated.
    rows += [(3000 + k, "http://articles.example/", f"<body><article><p>Same here.</p><p>{PROSE} {k}</p></article></body>") for k in range(9)]
    want |= {2000 + k: f"Same here.\n{PROSE} {k}" for k in range(3)} | {3000 + k: f"Same here.\n{PROSE} {k}" for k in range(9)}
    got = {r["page_id"]: r["text"] for r in htmltext.op9(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: got[i] for i in want} == want
    assert all(PROSE in got[1000 + k] for k in range(9))


def test_paths_of_a_host_decide_where_a_page_is_unclear(spark):
    usual = '<html><body><div class="story">{}</div><div class="more">{}</div></body></html>'
    rows = [(k, "http://h.example/", usual.format(f"<p>{PROSE} {k}</p>", "<p>More.</p>")) for k in range(6)]
    # Here the other container holds more text, but the host's pages have voted.
    rows.append((6, "http://h.example/", usual.format(f"<p>{PROSE}</p>", f'<p>{PROSE} x <a href="1">{PROSE}</a></p><p>{PROSE} y</p>')))
    got = {r["page_id"]: r["text"] for r in htmltext.op9(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[6].startswith(PROSE) and got[3].startswith(f"{PROSE} 3")
