import random

import numpy as np
import pytest

from attesta.llm import htmltext
from attesta.llm.htmltext import main_text

LONG = "A paragraph of running text that says something at some length, as articles do, with commas and all."


def page(body):
    return f'<!DOCTYPE html><html lang="en"><head><title>Title</title><style>p{{}}</style><script>var t="</p>";</script></head><body>{body}</body></html>'


def test_furniture_goes():
    body = (
        '<header><h1>Site</h1><nav><ul><li><a href="/">Home</a></li></ul></nav></header><div class="cookie-notice">We use cookies, a long sentence about it.</div>'
        f'<!-- ad --><div class="ad">Buy &amp; save</div><article><header><h1>Head&shy;line &amp;amp; more</h1></header><p>{LONG}<p>Short.<p><b>{LONG}<br>x\n\t y</b>'
        '<form><input><button>Send</button></form><aside>Also</aside><noscript>none</noscript><div class="share-buttons">Share</div></article>'
        '<section id="comments"><article>Nice post, thanks for it all</article></section><div hidden>secret</div><p style="display: none">no</p><footer>&copy; me</footer>'
    )
    assert main_text(page(body)) == f"Head\xadline &amp; more\n{LONG}\nShort.\n{LONG} x y"


def test_a_box_around_the_article_is_no_furniture():
    assert main_text(page(f'<div class="layout with-sidebar"><article><p>{LONG}</p></article><div class="sidebar">{LONG}</div></div>')) == LONG


def test_comments_that_are_articles_stay_out():
    body = f'<article><h1>H</h1><p>{LONG}</p></article><section class="reader-comments"><article><p>{LONG}{LONG}{LONG}</p></article></section><ins class="adsbygoogle">{LONG}</ins>'
    assert main_text(page(body)) == f"H\n{LONG}"


def test_pages_without_article_use_the_clusters():
    links = "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(12))
    body = f'<div><ul>{links}</ul></div><div id="content"><h2>Head</h2><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div><a href="/">up</a></div>'
    assert main_text(page(body)) == "\n".join(["Head", LONG, LONG, LONG])


PROSE = "\n".join([LONG] * 3)
PARAGRAPHS = f"<p>{LONG}</p>" * 3


@pytest.mark.parametrize(
    ("body", "text"),
    [
        (f'<form id="aspnetForm"><nav><a href="/">Home</a></nav><div>{PARAGRAPHS}</div></form>', PROSE),
        (f'<form><article>{PARAGRAPHS}</article><div>{LONG}{LONG}{LONG}{LONG}</div></form>', PROSE),
        (f'<div>{PARAGRAPHS}</div><form><label>Your name and address, please</label></form>', PROSE),
        (f'<main>{PARAGRAPHS}<article><h3><a href="/x">Another story</a></h3><p>{LONG}</p></article></main>', PROSE),
        (f'<main>{PARAGRAPHS}<article><p>{LONG}</p></article></main>', f"{PROSE}\n{LONG}"),
        (f'<main><p>{LONG}</p><article>{PARAGRAPHS}</article></main>', PROSE),
        (f'<article><h2 id="related-work">Related work</h2><p>{LONG}</p><h2 id="search">Search</h2><p>{LONG} <span class="login">login</span></p></article>', f"Related work\n{LONG}\nSearch\n{LONG} login"),
        (f'<article><p style="display:none">no<p>{LONG}<ul><li hidden>no<li>yes</ul><dl><dt hidden>no<dd>d</dl><table><tr><td class="ad">no<td>cell</table></article>', f"{LONG}\nyes\nd\ncell"),
    ],
)
def test_ordinary_layouts_keep_their_article(body, text):
    assert main_text(page(body)) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("   ", ""), ("<p>", ""), ("<script>x</script><nav>a</nav>", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\nb"),
        ("<article><p>cut off mid-ta", "cut off mid-ta"), ("<article><p>x</div></article></p>y", "x"), ("<table><tr><td>a</td><td>b</td></tr><tr><td>c</table>", "a b\nc"),
        ("<article>&#x41;&lt;b&gt;&nbsp;&nbsp;&bogus; <i>c</i>d</article>", "A<b> &bogus; cd"), ("<article><![CDATA[x]]><![if !IE]>y<![endif]></article>", "y"),
        ("<div class='ad'>only this</div>", "only this"),
    ],
)
def test_odd_markup(html, text):
    assert main_text(html) == text


def test_very_long_and_deep():
    assert main_text("<article>" + "<div>" * 3000 + "deep" + "</article>") == "deep"
    assert len(main_text("<article>" + f"<p>{LONG}</p>" * 5000)) == 5000 * (len(LONG) + 1) - 1


def test_smoothing_keeps_the_mean():
    flat = htmltext.smoothed(np.full(9, 4.0))
    assert np.allclose(flat, 4.0)


def test_frame(make):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, "u", "<article><p>é 😀</p></article>", "t", "n"), (None, None, None, None, None), (1, "u", "<article><p>é 😀</p></article>", "t", "n")]
    out = sorted(map(tuple, htmltext.extracted(make(schema, rows)).collect()), key=str)
    assert out == sorted([(1, "u", "é 😀", 3), (None, None, "", 0), (1, "u", "é 😀", 3)], key=str)
    assert htmltext.extracted(make(schema, [])).count() == 0


TALE = " ".join(["The harbour lay quiet under the morning fog while the boats waited for the tide to turn."] * 2)


def test_sections_named_by_their_heading_stay():
    page = (
        f'<body><nav><a href="/">Home</a></nav><article><h1>Guide</h1><p>{TALE}</p><section id="search"><h2>Search</h2><p>{TALE} S</p></section>'
        f'<div class="section" id="related-work"><h2>Related work</h2><p>{TALE} R</p></div><div id="navigation-2"><h2>Navigation</h2><p>{TALE} N</p></div>'
        f'<div id="related"><h3>Related</h3><a href="x">Other page</a><a href="y">One more page</a></div>'
        f'<section id="comments"><h2>Comments</h2><p>{TALE} C</p></section><section class="reader-feedback"><h2>Readers</h2><p>{TALE} F</p></section></article></body>'
    )
    assert main_text(page).split("\n") == ["Guide", TALE, "Search", f"{TALE} S", "Related work", f"{TALE} R", "Navigation", f"{TALE} N"]


def test_parts_of_a_split_article_stay():
    parts = f"<article><h2>One</h2><p>{TALE} 1</p></article><article><h2>Two</h2><p>{TALE} 2</p></article>"
    card = '<article><a href="x"><h3>Teaser</h3></a><p>Read more about this one here.</p></article>'
    for page in (f"<body><main>{parts}{card}</main></body>", f"<body><div>{parts}</div>{card}</body>"):
        assert main_text(page).split("\n") == ["One", f"{TALE} 1", "Two", f"{TALE} 2"]


def test_formulas_stay_and_unclosed_elements_end_with_their_box():
    formula = "<math><mi>x</mi><annotation encoding='tex'>\\x</annotation></math>"
    assert main_text(f"<article><p>Let {formula} be. {TALE}</p></article>") == f"Let x be. {TALE}"
    for tag in ("button", "svg", "select"):
        assert main_text(f"<body><div><{tag}>Press</div><article><p>{TALE}</p><p>End {TALE}</p></article></body>") == f"{TALE}\nEnd {TALE}"
    assert main_text(f"<article><svg><g></g><text>no</text></svg><p>{TALE}</p></article>") == TALE


def test_menu_links_in_the_next_cell_go():
    page = f"<table><tr><td><a href='a'>Home</a></td></tr><tr><td><p>{TALE}</p><p>{TALE} more</p></td></tr><tr><td><a href='b'>Contact us</a></td></tr></table>"
    assert main_text(page) == f"{TALE}\n{TALE} more"


def _page(seed):
    """A page made from a tree of parts, and the text that its article holds, read from that tree."""
    r = random.Random(seed)
    words = "harbour fog boats tide morning quiet lamp stone market bridge river letter window garden winter train".split()

    def sentence(n):
        return " ".join(r.choice(words) for _ in range(n)).capitalize() + "."

    def inline(text):
        parts = text.split()
        at = r.randrange(len(parts))
        parts[at] = r.choice(["<b>{}</b>", "<em>{}</em>", "<a href='x'>{}</a>", "<span class='n'>{}</span>", "{}<wbr>", "{}<!-- x -->", "{}"]).format(parts[at])
        return r.choice([" ", "\n", "  "]).join(parts)

    blocks, tags = [], []
    for _ in range(r.randrange(3, 9)):
        kind = r.choice("pppphuq")
        text = sentence(r.randrange(25, 60))
        if kind == "h":
            text = sentence(3)
            tags.append(f"<h2>{text}</h2>")
        elif kind == "u":
            items = [sentence(12) for _ in range(r.randrange(2, 4))]
            tags.append("<ul>" + "".join(f"<li>{inline(i)}" + r.choice(["</li>", ""]) for i in items) + "</ul>")
            blocks += items
            continue
        elif kind == "q":
            text = f"{text} A & B < C é."
            tags.append(f"<blockquote><p>{text.replace('&', '&amp;').replace('<', '&lt;').replace('é', '&eacute;')}</p></blockquote>")
        else:
            tags.append(f"<p>{inline(text)}" + r.choice(["</p>", ""]))
        blocks.append(text)
    tags.append(f"<p>{TALE}</p>")
    blocks.append(TALE)
    links = "".join(f"<li><a href='/{i}'>{r.choice(words)}</a></li>" for i in range(6))
    before = r.sample([f"<nav><ul>{links}</ul></nav>", f"<header><h1>Site</h1><ul>{links}</ul></header>", "<div class='cookie-notice'>We use cookies.</div>", "<script>var a = '<p>no</p>';</script>", f"<div id='menu'>{links}</div>"], 3)
    after = r.sample([f"<aside><h3>More</h3>{links}</aside>", f"<footer>About us <a href='x'>Terms</a></footer>", f"<div class='comments'><p>{sentence(30)}</p></div>", f"<div class='sidebar'>{links}</div>", "<form><input name='q'><button>Go</button></form>"], 3)
    inside = r.choice(["", "<div class='share'><a href='s'>Share</a></div>", f"<div class='advert'>{sentence(9)}</div>", "<style>p {}</style>"])
    cut = r.randrange(len(tags) + 1)
    body = "\n".join([*tags[:cut], inside, *tags[cut:]])
    wrap = r.choice(["<article>{}</article>", "<main><article>{}</article></main>", "<main>{}</main>", "<div class='wrapper'><article class='post'>{}</article></div>"])
    return f"<!doctype html><html><head><title>T</title></head><body>{''.join(before)}{wrap.format(body)}{''.join(after)}</body></html>", "\n".join(blocks)


@pytest.mark.parametrize("seed", range(150))
def test_generated_pages_give_the_text_of_their_tree(seed):
    html, text = _page(seed)
    assert main_text(html) == text
