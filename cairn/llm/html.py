"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import bisect
import html as references
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import read_table

# Elements of HTML by their part in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title select svg math object canvas audio video noframes noembed".split())
REFUSED = RAW | frozenset("nav footer aside button menu dialog head datalist".split())
HINTS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe teaser toolbar widget".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar alert alertdialog dialog toolbar".split())
#: What ends an open element of the key when it starts.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
#: Elements that an implied end does not reach out of.
WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}}

_TOKEN = (
    r"<!--(?:.*?(?P<done>-->)|.*\Z)|<(?P<raw>script|style|textarea|title|iframe|noframes|noembed)\b{attrs}>.*?(?:(?P<closed></(?P=raw)\s*+>)|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>{attrs})>|(?P<broken><(?=/?[a-zA-Z]))|<[!?/][^>]*+>"
)
#: Tags whose attributes' quotes shield a ``>``, and tags up to the next one.
QUOTED, PLAIN = (re.compile(_TOKEN.replace("{attrs}", attrs), re.IGNORECASE | re.DOTALL) for attrs in (r"(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+", r"[^>]*+"))
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
#: Share of the page's largest fused score that a path needs, and of the selected text that a content element must hold.
THRESHOLD, HELD = 0.2, 0.85
#: Share of the page's selected text, or of its own text as selected, from which an ``article`` or ``main`` is text as a whole.
MOST = 0.5


def tokens(source: str) -> Iterator[re.Match]:
    """Comments, raw elements and tags of a page, in one pass: each match is tried at a place that none has read before.

    Quotes in a tag shield what is between them, up to a tag whose quotes never close; from there on they don't. What
    follows the last ``>`` holds no tag.
    """
    end, at = source.rfind(">") + 1, 0
    for m in QUOTED.finditer(source, 0, end):
        if m["broken"] is None:
            yield m
            at = m.end()
        else:
            yield from (m for m in PLAIN.finditer(source, at, end) if m["broken"] is None)
            return


class Page:
    """The blocks of text of a page with the element and the tag path each stands in."""

    def __init__(self, source: str):
        self.parent, self.tag, self.path, self.refused, self.hint = [-1], ["#root"], [0], [False], [False]
        self.in_article = [False]
        self.open_at: dict[str, list[int]] = {}
        self.paths: dict[tuple, int] = {}
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self._read(source)

    def _open(self, at: int, tag: str, attrs: str) -> int:
        kind, refused, hint = tag, self.refused[at] or tag in REFUSED, tag == "form"
        if tag == "header" and not self.in_article[at]:
            refused = True
        if attrs:
            for m in ATTRIBUTE.finditer(attrs):
                name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                words = re.split(r"[^a-z0-9]+", value)
                if name in ("hidden", "aria-hidden"):
                    refused |= name == "hidden" or value == "true"
                elif name == "role":
                    refused |= not ROLES.isdisjoint(words)
                    hint |= "form" in words
                elif tag not in ("html", "body", "article", "main"):
                    hint |= not HINTS.isdisjoint(words)
                    kind += "." + value
        self.parent.append(at)
        self.tag.append(tag)
        self.path.append(self.paths.setdefault((self.path[at], kind), len(self.paths) + 1))
        self.refused.append(refused)
        self.hint.append(hint)
        self.in_article.append(self.in_article[at] or tag in ("article", "main"))
        return len(self.parent) - 1

    def _up(self, at: int, tags: set[str], walls: set[str]) -> int:
        """The parent of the outermost open element with one of ``tags``, as far as the first wall; else ``at``."""
        wall = max((self.open_at[t][-1] for t in walls if self.open_at.get(t)), default=0)
        found = [nodes[i] for nodes in map(self.open_at.get, tags) if nodes and (i := bisect.bisect(nodes, wall)) < len(nodes)]
        return self.parent[min(found)] if found else at

    def _read(self, source: str) -> None:
        at, texts, in_link, linked, last = 0, [], 0, 0, 0
        #: The open elements of each tag, outermost first: numbers grow along the open ones.
        open_at = self.open_at

        def flush() -> None:
            nonlocal linked
            if texts:
                text = " ".join("".join(texts).split())
                if text:
                    self.blocks.append((at, text, min(linked, len(text))))
                texts.clear()
            linked = 0

        def move(to: int) -> None:
            nonlocal at
            while at != to:
                open_at[self.tag[at]].pop()
                at = self.parent[at]

        for m in tokens(source):
            if m.start() > last and not self.refused[at]:
                text = references.unescape(source[last : m.start()])
                texts.append(text)
                linked += len(text) * bool(in_link)
            last = m.end()
            if (m["raw"] and not m["closed"]) or (source.startswith("<!--", m.start()) and not m["done"]):
                last = len(source)  # what never ends takes the rest of the page
            tag = (m["name"] or "").lower()
            if not tag:
                if m["raw"]:
                    texts.append(" ")
                continue
            end, attrs = m["end"], m["attrs"]
            if tag in INLINE:
                if tag == "a":
                    in_link = 0 if end else 1
                elif tag in ("br", "img", "input", "wbr"):
                    texts.append(" " * (tag != "wbr"))
                continue
            flush()
            in_link = 0
            if end:
                if open_at.get(tag):
                    move(self.parent[open_at[tag][-1]])
            else:
                if open_at.get("p"):
                    move(self._up(at, {"p"}, {"td", "th", "li", "table", "button", "object"}))
                if tag in ENDS and any(map(open_at.get, ENDS[tag])):
                    move(self._up(at, ENDS[tag], WALLS.get(tag, set())))
                if tag not in VOID:
                    at = self._open(at, tag, attrs)
                    open_at.setdefault(tag, []).append(at)
        if last < len(source) and not self.refused[at]:
            texts.append(references.unescape(source[last:].partition("<!--")[0]))
        flush()

    def sums(self, of: np.ndarray, amounts: np.ndarray) -> np.ndarray:
        """For every element the sum of ``amounts`` of the blocks in it; ``of`` tells their elements."""
        out = np.zeros(len(self.parent))
        np.add.at(out, of, amounts)
        for i in range(len(out) - 1, 0, -1):
            out[self.parent[i]] += out[i]
        return out

    def within(self, elements: list[int]) -> np.ndarray:
        """Which elements are, or stand in, one of ``elements``."""
        out = np.zeros(len(self.parent), bool)
        out[elements] = True
        for i in range(1, len(out)):
            out[i] |= out[self.parent[i]]
        return out


def path_scores(paths: np.ndarray, lengths: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The fused score of every block: text length and punctuation a node of its tag path, smoothed along the page, multiplied."""
    n = np.bincount(paths)
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2.0)
    weight = np.convolve(np.ones(len(paths)), kernel)[2:-2]
    smooth = [np.convolve((np.bincount(paths, v) / np.maximum(n, 1))[paths], kernel)[2:-2] / weight for v in (lengths, marks)]
    return smooth[0] * (1 + smooth[1])


def selected(page: Page, blocks: list[tuple[int, str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The elements, lengths and characters in links of ``blocks``, and which of them the path scores select."""
    of = np.array([b[0] for b in blocks])
    lengths = np.array([len(b[1]) for b in blocks], float)
    links = np.array([b[2] for b in blocks], float)
    marks = np.array([len(PUNCTUATION.findall(b[1])) for b in blocks], float)
    scores = path_scores(np.array(page.path)[of], lengths - links, marks)
    plain = links <= 0.5 * lengths
    chosen = (scores >= THRESHOLD * scores.max()) & plain
    return of, lengths, links, chosen if chosen.any() else plain


def hinted_elements(page: Page, blocks: list[tuple[int, str, int]]) -> np.ndarray:
    """Which elements stand in one that a hint marks; a hint is void on an element around most of the page's text.

    That is one with an ``h1`` or ``main`` too; or with an ``article`` or nearly all text, if no article or ``h1``
    with more text than headings stands outside all hints: then the hint marks what comes with that, as a long thread of
    comments. A form hints too, and is void only if most of its text is sentences. Text is that of blocks that aren't
    mostly links.
    """
    of, links = np.array([b[0] for b in blocks]), np.array([b[2] for b in blocks], float)
    lengths = np.array([len(b[1]) for b in blocks], float)
    lengths[links > 0.5 * lengths] = 0
    held = page.sums(of, lengths)
    hint, tags, refused = np.array(page.hint), np.array(page.tag), np.array(page.refused)
    free = ~page.within(np.flatnonzero(hint))
    leading = page.sums(np.flatnonzero(np.isin(tags, ("h1", "main")) & ~refused), 1) > 0
    articles = page.sums(np.flatnonzero((tags == "article") & ~refused), 1) > 0
    own = page.sums(of, lengths * free[of])
    heads = own[free & (tags == "h1")].sum()
    beside = own[free & np.isin(tags, ("h1", "article"))].any() and own[0] > 2 * heads
    void = (held > MOST * held[0]) & (leading | (articles | (held >= HELD * held[0])) & (not beside))
    # a form around a page holds sentences, one to fill in holds labels
    sentences = page.sums(of, lengths * np.array([PUNCTUATION.search(b[1]) is not None for b in blocks]))
    void &= (tags != "form") | (sentences > MOST * held)
    return page.within(np.flatnonzero(hint & ~void))


def extract(source: str | None) -> str:
    """The main text of a page, its blocks joined by an empty line; a null page counts as empty.

    Text length and punctuation are aggregated for each root-to-leaf tag path, smoothed along the page and fused; paths
    above a share of the largest score select content nodes, on every page. What stands around them is text too: in an
    ``article`` or ``main`` that holds most of the selected text, or is itself selected for the most part; where such
    elements don't hold most of it, in the innermost element that holds nearly all. Selected blocks outside these stay. Left
    out are blocks in elements for menus, headers, footers, sidebars, adverts, forms or comments, or made of links;
    a class or id that hints at these is passed over on an element around most of the page's text.
    Paths carry classes, so boxes of the same element differ; inline elements don't part a path or a block.
    """
    page = Page(source or "")
    blocks = [b for b in page.blocks if not page.refused[b[0]]]
    if not blocks:
        return ""
    if any(page.hint):
        hinted = hinted_elements(page, blocks)
        blocks = [b for b in blocks if not hinted[b[0]]]
        if not blocks:
            return ""
    of, lengths, links, chosen = selected(page, blocks)
    if not chosen.any():
        return ""
    held, whole = page.sums(of, lengths * chosen), page.sums(of, lengths)
    articles = [i for i, tag in enumerate(page.tag) if tag in ("article", "main") and held[i] and held[i] >= MOST * min(held[0], whole[i])]
    inside = page.within(articles)[of]
    if lengths[chosen & inside].sum() < MOST * held[0]:
        inside |= page.within([max(i for i in range(len(held)) if held[i] >= HELD * held[0])])[of]
    inside |= chosen
    # a path of which most text is links is a menu, wherever it stands
    path = np.array(page.path)[of]
    menu = (np.bincount(path, links) > 0.5 * np.bincount(path, lengths))[path]
    return "\n\n".join(b[1] for b, kept in zip(blocks, inside & ~menu, strict=True) if kept)


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, ``text`` and its ``n_chars``.

    Pages are independent: no shuffle; repeated rows repeat, an empty table gives an empty result, other columns are not
    read. A null or empty page, or one of nothing but menus, has the empty text.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url"), "html").mapInArrow(_extract_batches, f"page_id {kind}, url string, text string, n_chars bigint")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))
