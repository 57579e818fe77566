import html
import re

import pytest

from cairn.llm.html import extract, extract_pages, op4

LONG = "Some sentences, with words; enough of them to count. And another one, to be sure."


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), ("   ", ""), ("<html><nav><a href=x>Home</a></nav></html>", ""), ("just text", "just text"), ("a < b &amp; c", "a < b & c"),
        (f"<article><h1>Title</h1><p>{LONG}<p>Two\n  three&nbsp;&eacute;<br>four</article>", f"Title\n\n{LONG}\n\nTwo three é four"),
        (f"<body><header><p>{LONG}</p></header><article><p>{LONG}</p><aside>{LONG}</aside><p>Short.</p></article><footer>{LONG}</footer>", f"{LONG}\n\nShort."),
        (f"<div class=menu><a>One</a><a>Two</a></div><div class=main><h2>Head</h2><p>{LONG}</p><p>x</p></div><div id=comments><p>{LONG} {LONG}</p></div>", f"Head\n\n{LONG}\n\nx"),
        (f"<article><script>var a = '<p>no</p>';</script><style>p {{}}</style><!-- <p>no</p> --><p>{LONG}</p><form>Name <input></form></article>", LONG),
        (f"<article><p><b>{LONG}<br><p>And <i>more</i> of<wbr>it</p></article>", f"{LONG}\n\nAnd more ofit"),
        (f"<ARTICLE><P TITLE='a > b'>{LONG}</P></ARTICLE>", LONG), (f"<article><div><div>{LONG}", LONG), (f"<article><p>{LONG}</p></article><script>unclosed <p>no", LONG),
        (f"<article><p>{LONG}</p><ul><li>one<li>two, with text</ul><table><tr><td>a<td>b</table></article>", f"{LONG}\n\none\n\ntwo, with text\n\na\n\nb"),
        (f'<article><p>{LONG}</p><div class="ad-box advert">Buy this, now.</div><p hidden>no</p><div role="navigation">no</div></article>', LONG),
    ],
)
def test_pages(page, text):
    assert extract(page) == text


def test_path_scores_select_beside_articles():
    """A story in divs is the text though cards beside it are articles; of articles, paths choose too."""
    story = "".join(f"<div class=par>{LONG} {LONG} {i}</div>" for i in range(6))
    cards = "".join(f"<article><h3>Card {i}</h3><div>Short.</div></article>" for i in range(3))
    assert extract(f"<body><div class=story>{story}</div><div class=more>{cards}</div>") == "\n\n".join(f"{LONG} {LONG} {i}" for i in range(6))
    assert extract(f"<body><article><p>{LONG}</p><p>Short.</p></article><div class=rest><p>{LONG} {LONG}</p></div>") == f"{LONG}\n\nShort.\n\n{LONG} {LONG}"


def test_selected_blocks_stay_wherever_they_stand():
    paragraphs = [f"{LONG} {i}" for i in range(22)]
    parts = [f"<section>{''.join(f'<p>{p}</p>' for p in part)}</section>" for part in (paragraphs[:1], paragraphs[1:21], paragraphs[21:])]
    assert extract(f"<div id=content>{''.join(parts)}</div>") == "\n\n".join(paragraphs)


@pytest.mark.parametrize("name", ["content has-sidebar", "layout with-sidebar", "post no-ads", "page-with-footer"])
def test_hints_on_wrappers_are_void(name):
    story, side = f"<h1>Head</h1><p>{LONG}</p><p>{LONG} {LONG}</p>", f"<div class=sidebar><p>{LONG}</p></div>"
    text = f"Head\n\n{LONG}\n\n{LONG} {LONG}"
    assert extract(f"<div id=top>Site</div><div class='{name}'>{story}{side}</div>") == text
    assert extract(f"<div class='{name}'><article>{story}</article>{side}</div>") == text
    assert extract(f"<div class='{name}'><p>{LONG}</p><p>{LONG}</p></div>") == f"{LONG}\n\n{LONG}"
    thread = f"<p>{LONG}</p>" * 30
    assert extract(f"<article>{story}</article><div class=comment-list>{thread}</div>") == text
    assert extract(f"<article>{story}<div class=comments>{thread}</div></article>") == text
    assert extract(f"<article><h1>Head</h1><div class='{name}'><p>{LONG}</p></div></article>") == f"Head\n\n{LONG}"


def test_long_and_deep_pages():
    assert extract("<article>" + f"<p>{LONG}</p>" * 20000 + "</article>").count("\n\n") == 19999
    assert extract("<div>" * 20000 + LONG) == LONG


def test_forms_around_pages():
    story = f"<h1>Head</h1><p>{LONG}</p><p>{LONG} {LONG}</p>"
    menu = "<div class=top><a href=1>Menu</a> <a href=2>Other</a></div>"
    assert extract(f"<form id=page>{menu}<div id=main>{story}</div></form>") == f"Head\n\n{LONG}\n\n{LONG} {LONG}"
    assert extract(f"<div>{story}</div><form><p>Name</p><p>Say {LONG}</p></form>") == f"Head\n\n{LONG}\n\n{LONG} {LONG}"
    assert extract("<form><label>Name</label><div>Street</div><button>Send</button></form>") == ""


@pytest.mark.parametrize("part", ["<a ", "<a b='x ", '<a b="x ', "<!-- ", "<", "&amp", "<script>", "<p>x<div>", "<li><div>x", "<ul><li><ul><div>", "<b '>' ", "</x", "<td><p><table>", "<a" * 9 + " "])
def test_malformed_pages_take_linear_time(part):
    import time

    began = time.perf_counter()
    extract(part * (1_000_000 // len(part)) + f"'\"><p>{LONG}</p>")
    assert time.perf_counter() - began < 20


def test_unclosed_parts():
    assert extract(f"<p>{LONG}</p><!-- never <p>closed</p>") == LONG and extract(f"<p>{LONG}</p><!-- never") == LONG
    assert extract(f"<!DOCTYPE html><p>{LONG}</p a=\"><p>{LONG}</p>") == f"{LONG}\n\n{LONG}"
    assert extract(f"<p>{LONG} <a href='x") == f"{LONG} <a href='x"


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", f"<article><p>{LONG}</p></article>", 3), (1, "u", f"<article><p>{LONG}</p></article>", 3), (2, None, None, 3), (None, "v", "", 3)], "page_id long, url string, html string, text int")
    rows = sorted((r["page_id"] or 0, r["n_chars"], r["text"]) for r in extract_pages(df).collect())
    assert rows == [(0, 0, ""), (1, len(LONG), LONG), (1, len(LONG), LONG), (2, 0, "")]
    assert extract_pages(df.limit(0)).count() == 0


def test_pages_without_articles(spark, data_dir):
    """What an article holds is found by its paths alone when the article is a plain element."""
    for r in spark.read.parquet(f"{data_dir}/pages.parquet").collect():
        plain = re.sub(r"<(/?)article\b", r"<\1div", r["html"])
        assert extract(plain) == extract(r["html"])


def test_whole_table(spark, data_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data_dir}/pages.parquet").collect()}
    rows = op4(spark, data_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])
