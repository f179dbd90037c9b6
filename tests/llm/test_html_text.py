import math

import pytest

from talus.llm.html_text import blocks, extract_main_text, fused_ratios, main_text

PROSE = "The old mill stood by the river, and nobody had entered it for years. When the door opened at last, dust fell in long, slow curtains."
PAGE = f"""<!DOCTYPE html><html><head><title>Mill</title><style>p {{color: red}}</style><script>var x = "<p>no</p>";</script></head><body>
<header><a href="/">Home</a> Site name</header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies, and so on. Accept them, please.</div>
<div id="content"><article><header><h1>The mill</h1></header><p>{PROSE}<p>Tea &amp; cake &lt;3, said the&nbsp;miller. It was&#8217;nt   much,
 but it was warm.<!-- hidden, text. --><blockquote>Quoted words, with a comma.</blockquote><ul><li>First point, short.<li>Second point.</ul>
<div class="ad">Buy now, cheap!</div><p hidden>Not shown, ever.</p><pre>x = 1</pre><table><tr><td>Cell one<td>Cell two</table>
<aside>More stories, many of them.</aside></article>
<section class="comments"><h2>Comments</h2><p>I liked this, a lot. Really, I did, and so did my brother.</p></section></div>
<form><label>Mail</label><input name=q><button>Send</button></form><footer>&copy; 2020, all rights reserved.</footer></body></html>"""


def test_article_without_boilerplate():
    lines = main_text(PAGE).split("\n")
    assert lines == [
        "The mill", PROSE, "Tea & cake <3, said the miller. It was’nt much, but it was warm.", "Quoted words, with a comma.",
        "First point, short.", "Second point.", "x = 1", "Cell one", "Cell two",
    ]


def test_page_without_article_element():
    page = f"<div class=menu><a href=1>News, all.</a> <a href=2>Sport</a></div><div class=post><h2>Head</h2><p>{PROSE}</p><p>{PROSE}</p></div>"
    page += "<div class=links><p><a href=3>Other stories, here</a></p><p><a href=4>And there</a></p></div><div class='footer'>Imprint</div>"
    assert main_text(page) == f"Head\n{PROSE}\n{PROSE}"


@pytest.mark.parametrize("page", [None, "", "   ", "<div", "<!--", "<p></p>", "<script>only", "</p></div>", "<nav><p>Menu, only.</p></nav>"])
def test_pages_without_text(page):
    assert main_text(page) == ""


def test_broken_markup_and_very_long_pages():
    assert main_text("<article><p><b>Bold, never closed.<br><p>Next one.") == "Bold, never closed.\nNext one."
    assert main_text("<article><p>a < b, and c > d.</p>").startswith("a < b")
    long = "<article>" + f"<p>{PROSE}</p>" * 3000 + "</article>"
    assert main_text(long) == "\n".join([PROSE] * 3000)
    assert len(blocks("<div>" * 4000 + "deep, text" + "</div>" * 4000)) == 1


def test_frame(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "y"), (None, "v", "", "z")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in extract_main_text(frame).collect()))
    text = main_text(PAGE)
    assert got == [(0, "", 0), (1, text, len(text)), (1, text, len(text)), (2, "", 0)]
    assert extract_main_text(spark.createDataFrame([], frame.schema)).count() == 0


BARE = (
    "<html><body><div><a href=1>Home</a> <a href=2>News</a> <a href=3>Sport</a></div><div><div>Buy now, cheap shoes!</div><div><h2>The mill</h2>"
    + "".join(f"<p>{x}</p>" for x in (PROSE, "Short one.", PROSE + " " + PROSE))
    + "<ul><li>First point</li><li>Second, longer point</li></ul></div><div><div><span>Nice one, thanks.</span></div><div><span>I liked it.</span></div></div></div>"
    "<div>Copyright 2020</div></body></html>"
)


def brute_ratios(found):
    """The fused ratios and the threshold from their definition, path by path."""
    paths = {b.path for b in found}
    raw = {}
    for p in paths:
        mine = [b for b in found if b.path == p]
        chars, linked = sum(len(b.text) for b in mine), sum(min(b.linked, len(b.text)) for b in mine)
        raw[p] = ((chars - linked) / len(mine), sum(c in ".,;:!?…。，；：！？、" for b in mine for c in b.text) / len(mine), 1 - linked / chars)
    out, plain = {}, {}
    for p in paths:
        near = {p: 1.0}
        for q in paths - {p}:
            if q[:-1] == p or (p and p[:-1] == q):
                near[q] = 0.1
            elif p and q and p[:-1] == q[:-1]:
                near[q] = 0.05
        mean = [sum(k * raw[q][i] for q, k in near.items()) / sum(near.values()) for i in (0, 1)]
        weights = [float(s.rsplit("!", 1)[1]) for s in p if "!" in s]
        plain[p] = math.log1p(mean[0] * (mean[1] + 0.3)) * raw[p][2]
        out[p] = plain[p] * min([1, *weights]) * max([1, *weights])
        plain[p] *= min(1, min([1, *weights]) * max([1, *weights]))
    return out, max(0.5, 0.7 * max(plain.values()))


@pytest.mark.parametrize("page", [PAGE, BARE, "<p>One, only.</p>", "text at the root, <i>alone</i>" + BARE])
def test_ratios_match_brute_force(page):
    (got, threshold), (want, limit) = fused_ratios(blocks(page)), brute_ratios(blocks(page))
    assert got.keys() == want.keys() and threshold == pytest.approx(limit)
    assert all(got[p] == pytest.approx(want[p]) for p in want)


def test_ratios_decide_where_no_name_tells():
    assert main_text(BARE).split("\n") == ["The mill", PROSE, "Short one.", PROSE + " " + PROSE, "First point", "Second, longer point"]
    ratios, threshold = fused_ratios(blocks(BARE))
    assert sum(ratios[b.path] < threshold for b in blocks(BARE)) >= 5  # menu, advert, two comments, copyright line


def test_names_of_wrappers_and_of_boxes_in_the_article_do_not_lose_it():
    inner = f"<h1>The mill</h1><p>{PROSE}</p><p>{PROSE}</p>"
    whole = f"The mill\n{PROSE}\n{PROSE}"
    assert main_text(f"<div id='page-nav-wrapper' class='has-sidebar nav'><article>{inner}</article></div><div>Hello, you!</div>") == whole
    assert main_text(f"<form action=x>{inner}<input></form><div class=footer>Copyright 2020, all.</div>") == whole
    assert main_text(f"<article><h1>The mill</h1><p>{PROSE}</p><div class=share><p>{PROSE}</p></div></article>") == whole
    # A heap of comments without the main heading stays apart, however long.
    comments = "<section class=comments>" + f"<div><p>{PROSE}</p></div>" * 30 + "</section>"
    assert main_text(f"<article>{inner}</article>{comments}") == whole


def test_names_do_not_decide_alone():
    page = f"<div class=share><p>{PROSE}</p><p>{PROSE}</p></div><div class=post><p>Tiny.</p></div>"
    assert main_text(page).startswith(PROSE)
    assert main_text(f"<form><table><tr><td><p>{PROSE}</p></td></tr></table></form>") == PROSE
    assert main_text(f"<article><p>{PROSE}</p><figure><figcaption>A mill, seen from the road.</figcaption></figure><div class=ad>Buy, now!</div></article>").endswith("from the road.")
