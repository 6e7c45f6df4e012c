import pytest
from edge import answer

from veilmeter.llm.pages import articles, main_text

BODY = "".join(f"<p>Paragraph {i} tells a fair amount about the subject, in whole sentences.</p>" for i in range(5))
LINES = [f"Paragraph {i} tells a fair amount about the subject, in whole sentences." for i in range(5)]
MENU = "<nav><ul>" + "".join(f'<li><a href="/{i}">Menu item {i}</a></li>' for i in range(8)) + "</ul></nav>"


def page(inner):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{inner}</body></html>"


CASES = {
    "plain article": (page(MENU + f"<article><h1>Title</h1>{BODY}</article><footer>&copy; x</footer>"), ["Title", *LINES]),
    "no article element": (page(MENU + f'<div id="main">{BODY}</div><footer>Imprint</footer>'), LINES),
    "sidebar, notice, advert, form, comments": (
        page(
            MENU + '<header class="site"><h2>Site name</h2></header><div class="cookie-notice">We use cookies here.</div>'
            f'<div class="wrap"><article><header><h1>Title</h1></header>{BODY}<div class="ad">Buy this now</div>'
            '<form><label>Mail</label><input></form><section id="comments"><p>First! I read all of it, and more than once.</p>'
            '</section></article><aside class="sidebar"><p>Most read stories of the week and of the month</p></aside></div>'
        ),
        ["Title", *LINES],
    ),
    "script with markup": (page(f'<article><script>var t="</p><p>no";</script>{BODY}<style>.a>b{{}}</style></article>'), LINES),
    "references and white space": (page("<article><p>a &amp;\n  b&nbsp;&lt;c&gt; &#233;&#x1F642; &copy</p></article>"), ["a & b <c> é🙂 ©"]),
    "inline markup": (page("<article><p>one <b>two</b><i>three</i> <a href='x'>four</a><br>five</p></article>"), ["one twothree four five"]),
    "blocks": (page("<article>a<p></p>b<ul><li>c<li>d</ul><hr>e<blockquote>f<p>g</blockquote></article>"), list("abcdefg")),
    "table": (page("<article><table><tr><td>a<td>b<tr><td>c</table></article>"), ["a", "b", "c"]),
    "unclosed": ("<body><article><h1>T<p>one<p>two <b>three<p>four", ["T", "one", "two three", "four"]),
    "cut off": ("<body><article><p>one</p><p>two</p><foo", ["one", "two"]),
    "cut in a comment": ("<body><article><p>one</p><!-- ad", ["one"]),
    "attributes with marks": (page('<article><p title="a > b" data-x=\'<p>\'>one</p></article>'), ["one"]),
    "less-than in text": (page("<article><p>1 < 2 and 3 <4</p></article>"), ["1 < 2 and 3 <4"]),
    "stray ends": (page("<article></b><p>one</span></p></p></article></div>"), ["one"]),
    "hidden": (page(f'<article>{BODY}<p style="display: none">secret</p><p hidden>x</p><p aria-hidden="true">y</p></article>'), LINES),
    "frame classes around the article": (page(f'<div class="with-sidebar header-fixed"><article>{BODY}</article></div>'), LINES),
    "no markup": ("just words", ["just words"]),
    "nothing": (page("<script>1</script>"), []),
}


WRAPPED = {
    "article named by its state": f"<article class='post comments-open'>{BODY}</article>",
    "article named by its category": f"<article class='hentry category-social'>{BODY}</article>",
    "page class": f"<div class='page no-ads'><div>{BODY}</div></div>",
    "main with share": f"<main class='with-share'>{BODY}</main>",
    "form around the page": f"<form action='x'><input><div>{BODY}</div></form>",
    "form around the article": f"<form><article>{BODY}</article></form>",
    "a title is no attribute name": f"<article data-title='The hidden life of trees'>{BODY}</article>",
    "nor is a value a class": f"<article data-x=\"a class='ad' id=popup\">{BODY}</article>",
    "named comments beside an article": f"<article>{BODY}</article><ol class='list'><li><article class='comment-body'><p>{'Me too. ' * 90}</p></article></ol>",
    "long comments inside an article": f"<article>{BODY}<section id='comments'><p>{'Me too. ' * 90}</p></section></article>",
    "small form beside the text": f"<div>{BODY}</div><form><label>Your mail address</label><input></form>",
}


@pytest.mark.parametrize("name", WRAPPED)
def test_names_and_forms_around_the_article(name):
    assert main_text(page(MENU + WRAPPED[name])).split("\n") == LINES


PART = [f"<p>Part {i} holds a good many words of the main text, told in several sentences. It goes on.</p>" for i in range(6)]
TOLD = [p[3:-4] for p in PART]
LINKS = "<div>" + "".join(f"<div><a href='/{i}'>Read the story number {i} of this very day</a></div>" for i in range(12)) + "</div>"
SPREAD = {
    "sibling articles": "".join(f"<article><h2>Head {i}</h2>{PART[i]}</article>" for i in range(6)),
    "nested article": f"<article><h2>Head</h2>{PART[0]}{PART[1]}<article>{''.join(PART[2:])}</article><h2>End</h2></article>",
    "nested and long": f"<article><h2>Head</h2>{PART[0]}<article>{PART[1] * 8}</article>{PART[2]}</article>",
    "links in main": f"<main><h2>Head</h2><div>{''.join(PART)}</div>{LINKS}</main>",
    "links in an article": f"<article><h2>Head</h2><div>{''.join(PART)}</div>{LINKS}</article>",
}
TEXTS = {
    "sibling articles": [x for i in range(6) for x in (f"Head {i}", TOLD[i])],
    "nested article": ["Head", *TOLD, "End"],
    "nested and long": ["Head", TOLD[0], *[TOLD[1]] * 8, TOLD[2]],
    "links in main": ["Head", *TOLD],
    "links in an article": ["Head", *TOLD],
}


@pytest.mark.parametrize("name", SPREAD)
def test_density_decides_pages_with_articles(name):
    assert main_text(page(MENU + SPREAD[name])).split("\n") == TEXTS[name]
    assert main_text(page(MENU + untagged(SPREAD[name]))).split("\n") == TEXTS[name]


def untagged(source):
    """The page with div in place of article and main."""
    for tag in ("article", "main"):
        source = source.replace(f"<{tag}>", "<div>").replace(f"<{tag} ", "<div ").replace(f"</{tag}>", "</div>")
    return source


TOLD_LONG = [f"A rather long sentence number {i} that tells of the matter, and goes on for some while, until it ends." for i in range(12)]


def told(*lines):
    return "".join(f"<p>{x}</p>" for x in lines)


UNTAGGED = {
    "inner blocks": (
        f"<div class='content'><h1>Title</h1><div>{told(*TOLD_LONG[:2])}</div><div>{told(*TOLD_LONG[2:4])}</div><div>{told(TOLD_LONG[4])}</div></div>",
        ["Title", *TOLD_LONG[:5]],
    ),
    "a block of short lines": (
        f"<div><h1>Title</h1><div>{told('Short words.', 'Few words.')}</div><div>{told(*TOLD_LONG[:3])}</div></div>",
        ["Title", "Short words.", "Few words.", *TOLD_LONG[:3]],
    ),
    "title and lead": (f"<h1>Title</h1><div class='lead'>The lead.</div><div class='body'>{told(*TOLD_LONG)}</div>", ["Title", "The lead.", *TOLD_LONG]),
    "by-line": (f"<h1>Title</h1><p>By A. B.</p><div class='body'>{told(*TOLD_LONG)}</div>", ["Title", "By A. B.", *TOLD_LONG]),
    "rows of a table": (f"<table><tr><td>{told(*TOLD_LONG)}</td></tr><tr><td><p>The end.</p></td></tr></table>", [*TOLD_LONG, "The end."]),
    "links between title and text": (f"<h1>Site</h1>{LINKS}<div>{told(*TOLD_LONG)}</div>", TOLD_LONG),
}


@pytest.mark.parametrize("name", UNTAGGED)
def test_untagged_articles_keep_title_lead_and_short_blocks(name):
    source, lines = UNTAGGED[name]
    assert main_text(page(MENU + source + "<footer>Imprint</footer>")).split("\n") == lines


@pytest.mark.parametrize("section", ["<section id='search-for-life'>", "<section id='ad-1066'>", "<section class='social-history'>"])
def test_sections_named_by_their_subject_stay(section):
    text = f"<article><h1>T</h1>{BODY}{section}<h2>H</h2><p>{TOLD_LONG[0]}</p></section></article>"
    assert main_text(page(MENU + text)).split("\n") == ["T", *LINES, "H", TOLD_LONG[0]]


@pytest.mark.parametrize("section", ["class='ad-slot'", "class='x share-buttons'", "class='related-posts'", "id='comments'", "class='comments-area'", "role='search'"])
def test_furniture_inside_an_article_goes(section):
    text = f"<article><h1>T</h1>{BODY}<div {section}><h2>H</h2><p>{TOLD_LONG[0]}</p></div></article>"
    assert main_text(page(MENU + text)).split("\n") == ["T", *LINES]


# A header outside an article may be the site's, so its heading alone is no title.
KEEPS_TAGS = {"sidebar, notice, advert, form, comments"}


@pytest.mark.parametrize("name", sorted(set(CASES) - KEEPS_TAGS))
def test_case_without_tags(name):
    source, lines = CASES[name]
    assert main_text(untagged(source)).split("\n") == (lines or [""])


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    source, lines = CASES[name]
    assert main_text(source).split("\n") == (lines or [""])


def test_density_prefers_text_to_unnamed_link_lists():
    links = "<div>" + "".join(f'<div><a href="/{i}">Read story number {i} of today</a></div>' for i in range(30)) + "</div>"
    text = main_text(page(f"<div>{links}</div><div><div>{BODY * 3}</div></div>"))
    assert text.split("\n") == LINES * 3


def test_deep_and_long_pages():
    deep = main_text("<body>" + "<div>" * 20_000 + "text" + "</div>" * 20_000)
    assert deep == "text"
    long = main_text(page("<article>" + "<p>word word word.</p>" * 50_000 + "</article>"))
    assert long.count("\n") == 49_999
    assert main_text("<" * 50_000) == "<" * 50_000
    assert main_text("<a " + "x='" * 20_000) == ""


def test_edge_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", page(f"<article>{BODY}</article>")), (3, "u", page(f"<article>{BODY}</article>")), (None, "u", "x")]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("c"), "n_chars": F.lit("c")})
    body = "\n".join(LINES)
    want = [(1, "u", "", 0), (2, None, "", 0), (3, "u", body, len(body)), (3, "u", body, len(body)), (None, "u", "x", 1)]
    assert answer(articles(df)) == sorted(want, key=repr)
    assert articles(df.limit(0)).count() == 0
