import re
from collections import Counter

import numpy as np
import pytest

from lexfreq.llm import html_text
from lexfreq.llm.html_text import _Lines, extract, main_text, smoothed

PARAGRAPHS = ["A first paragraph with a number of words, long enough to be read by anyone who comes along.",
              "Short.", "The third one has a reference: R&D costs < 5 € and goes on for some more words than the second did."]
BODY = ("<h1>The title</h1><p>A first <b>paragraph</b> with a   number of\nwords, long enough to be read by <a href=x>anyone</a> who comes along."
        "<p>Short.</p><p>The third one has a reference: R&amp;D costs &lt; 5 &#8364; and goes on for some more words than the second did.</p>")
WANTED = "\n".join(["The title", *PARAGRAPHS])
JUNK = {
    "nav": "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>", "header": "<header><p>The site of the paper</p></header>",
    "notice": "<div class='cookie-notice'><p>We use cookies on this site, and many partners do as well, for all manner of things.</p></div>",
    "advert": "<div class=ad><p>Buy this now, it is the very best that money can buy today.</p></div>",
    "sidebar": "<aside><h2>Most read</h2><p>Another story about something else</p></aside><div id='sidebar'><p>More stories from around the web</p></div>",
    "form": "<form><label>Your name</label><input name=n><button>Send</button></form>", "script": "<script>var a = '</p><p>not text';</script><style>p{}</style>",
    "comments": "<section id='comments'><p>I do not agree with this article at all, and I have many words to say about it.</p></section>",
    "footer": "<footer>&copy; 2020 The site</footer>",
}


@pytest.mark.parametrize("name", JUNK)
@pytest.mark.parametrize("tag", ["article", "main", "div class='content'", "div class='post content-with-sidebar'"])
def test_junk_goes_wherever_it_stands(name, tag):
    end = tag.split()[0]
    page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{{}}<{tag}>{BODY}{{}}</{end}>{{}}</body></html>"
    for i in range(3):
        places = ["", "", ""]
        places[i] = JUNK[name]
        assert main_text(page.format(*places)) == WANTED


def test_all_junk_at_once_and_broken_markup():
    page = f"<html><body>{''.join(JUNK.values())}<article><p><b>Never closed.<br>New line<p>{BODY}</article>{JUNK['footer']}"
    assert main_text(page) == "Never closed. New line\n" + WANTED


@pytest.mark.parametrize("html,text", [(None, ""), ("", ""), ("   ", ""), ("plain text only", "plain text only"), ("<p>", ""),
                                       ("<nav>menu</nav>", ""), ("<p>a&nbsp;&nbsp;b\t c</p><p></p>", "a b c"), ("<div><p>x", "x")])
def test_small_pages(html, text):
    assert main_text(html) == text


def test_long_page():
    paragraphs = [f"Paragraph number {i} of a very long page that does not end." for i in range(20_000)]
    assert main_text("<article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article>") == "\n".join(paragraphs)


def test_smoothing_by_places():
    assert np.allclose(smoothed(np.ones(7), np.arange(7.0)), 1) and np.allclose(smoothed(np.array([3.0]), np.zeros(1)), 3)
    ratios, places = np.array([1.0, 5, 2, 9, 30, 4, 4, 7]), np.array([0.0, 1, 2, 4, 5, 6, 9, 10])
    weights = np.exp(-(places[:, None] - places)**2 / 2) * (abs(np.subtract.outer(np.arange(8), np.arange(8))) <= 2)
    assert np.allclose(smoothed(ratios, places), weights @ ratios / weights.sum(1))


def test_table(spark):
    rows = [(1, "u", BODY, "x", 3), (1, "u", BODY, "x", 3), (None, None, None, "x", None), (2, "v", "", "x", 1)]
    out = extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")).collect()
    assert sorted([tuple(r) for r in out], key=repr) == sorted(
        [(1, "u", WANTED, len(WANTED))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=repr)
    assert extract(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


@pytest.mark.parametrize("around", ["body", "div", "div class='content'", "main", "td"])
@pytest.mark.parametrize("part", ["div", "section", "article"])
def test_parts_of_unequal_length_are_all_kept(around, part):
    """An article in several containers, a short introduction and a short end among them."""
    long = [f"Sentence {i} of the long part goes on for some while, so that the part is much longer than all others." for i in range(30)]
    parts = [["A short introduction of a few words, which says what is to come."], ["Second title", *long], ["A third part, much shorter than the second."],
             ["Last title", "The end of it all, in one sentence of some length."]]
    own = "".join(f"<{part}>" + "".join(f"<p>{p}</p>" for p in lines) + f"</{part}>" for lines in parts)
    junk = JUNK["nav"] + JUNK["header"] + JUNK["sidebar"]
    page = f"<html><body>{junk}<{around}>{own}</{around.split()[0]}>{JUNK['comments']}{JUNK['footer']}</body></html>"
    assert main_text(page) == "\n".join(p for lines in parts for p in lines)


def test_depth_of_markup_does_not_matter():
    assert main_text("<div>" * 20_000 + f"<article>{BODY}" + "<div><p>and more of it, a sentence that goes on for some while</p>" * 2000).startswith(WANTED)


def unmarked(page):
    """The page without classes, ids, roles and the elements that say what a part of a page is."""
    page = re.sub(r"""\s(class|id|role)=("[^"]*"|'[^']*'|[^\s>]+)""", "", page)
    return re.sub(r"<(/?)(article|main|nav|header|footer|aside)\b", r"<\1div", page)


def kept_and_extra(pages):
    """Over the unmarked pages: the share of the lines of the main text that is kept, and of the other lines that is left out."""
    kept = wanted = extra = others = 0
    for page in pages:
        main, found = Counter(main_text(page).split("\n")), Counter(main_text(unmarked(page)).split("\n"))
        lines = _Lines()
        lines.feed(unmarked(page))
        lines.close()
        kept += (main & found).total()
        wanted += main.total()
        extra += (found - main).total()
        others += (Counter(line.text for line in lines.lines) - main).total()
    return kept / wanted, 1 - extra / others


def supplied_pages(spark):
    return [row.html for row in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]


def test_pages_without_names_and_roles_by_their_ratios(spark):
    kept, left_out = kept_and_extra(supplied_pages(spark))
    assert kept >= 0.95 and left_out >= 0.95


def test_without_the_ratios_the_other_lines_stay(spark, monkeypatch):
    monkeypatch.setattr(html_text, "in_cluster", lambda lines: [True] * len(lines))
    kept, left_out = kept_and_extra(supplied_pages(spark))
    assert kept == 1 and left_out < 0.5


LONG = "A sentence of the article that goes on for quite some while, with all that there is to say, until it comes to its end. "


@pytest.mark.parametrize("part", ["div", "section", "td"])
def test_links_and_short_texts_around_an_article_without_any_names(part):
    links = "".join(f"<li><a href=/{i}>A link to the story number {i} of the day</a></li>" for i in range(30))
    article = "<h2>The title</h2><p>" + LONG * 3 + "</p><p>Short.</p><p>" + LONG * 2 + "<a href=/z>with a link</a></p><p>" + LONG * 4 + "</p>"
    page = f"<body><div><ul>{links}</ul></div><div>Buy now.</div><{part}>{article}</{part}><div>All rights reserved.</div><div><ul>{links}</ul></div>"
    assert main_text(page) == "\n".join(["The title", (LONG * 3).strip(), "Short.", LONG * 2 + "with a link", (LONG * 4).strip()])


def test_names_inside_a_paragraph_do_not_part_it():
    assert main_text(f"<p>{LONG}<span class=ad>Buy!</span>And <a class=related href=/a>more</a> of it.</p>") == LONG + "And more of it."
    assert main_text(f"<p>{LONG}<a href=/a>one <a href=/b>two</a> three</p><p>{LONG}") == LONG + "one two three\n" + LONG.strip()


@pytest.mark.parametrize("inner", ["div", "section", "td"])
def test_short_parts_of_an_article_stay_with_it(inner):
    page = (f"<body>{JUNK['nav']}<main><div>Elsewhere</div><article><{inner}>Intro.</{inner}><div>" + f"<p>{LONG}{LONG}</p>" * 40
            + f"</div><{inner}><p>End.</{inner}></article></main>{JUNK['footer']}</body>")
    assert main_text(page) == "\n".join(["Intro.", *[(LONG + LONG).strip()] * 40, "End."])
