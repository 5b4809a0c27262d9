"""Main text of web pages: equivalence-class template deduction over the pages of a host."""

from __future__ import annotations

import functools
import html as references
import re
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import batch_of, map_batches, stored, text_or_empty
from cohortry.llm.template_classes import MODEL, PAGES, Layout, deduce, layouts_of

LEAST_PAGES = 8          # different pages a host needs before anything counts as its template
LINK_SHARE = 0.5         # of a block's characters, in pages that mark no article
LINK_SLOT_SHARE = 0.9    # of a slot's characters, over all pages of a host
TEMPLATE_SHARE = 0.9     # of a host's different pages that hold a class, for it to be template

# Element names by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead title tr ul option select".split())
APART = frozenset("head title nav header footer aside form menu dialog button select option textarea label".split())
WHOLE = frozenset("html body main".split())  # class words say nothing about these
ENDS_PARAGRAPH = BLOCK - {"body", "html", "head", "title", "td", "th", "tr", "tbody", "thead", "tfoot", "option"}
SELF_ENDING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
               "td": {"td", "th"}, "th": {"td", "th"}}
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login sidebar "
    "widget widgets menu nav navbar navigation breadcrumb breadcrumbs pagination pager share sharing social related "
    "recommended recommendations comment comments disqus reply replies respond footer header masthead toolbar "
    "search".split())
READER_WORDS = frozenset("comment comments disqus replies respond".split())  # never around the article
NOT_WORDS = frozenset("has with no without is".split())

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.trim(url.cast("string")), HOST, 1)), F.lit(""))


def _set_apart(name: str, attributes: dict[str, str]) -> bool:
    """Whether an element holds no main text, by its name, role, or as a place for readers."""
    if name in APART or attributes.get("role", "").lower() in APART_ROLES or attributes.get("aria-hidden", "") == "true":
        return True
    return "hidden" in attributes or name not in WHOLE and _named(attributes)[0]


def _named(attributes: dict[str, str]) -> tuple[bool, bool]:
    """Whether a class or the id begins or ends with one of READER_WORDS, or of APART_WORDS."""
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return (False, False) if names == " " else _words(names)


@functools.lru_cache(4096)
def _words(names: str) -> tuple[bool, bool]:
    ends = set()
    for one in names.lower().split():
        parts = [w for w in re.split(r"[^a-z]+", one) if w]
        if parts and parts[0] not in NOT_WORDS:
            ends |= {parts[0], parts[-1]}
    return not ends.isdisjoint(READER_WORDS), not ends.isdisjoint(APART_WORDS)


@dataclass
class Block:
    path: int            # hash of the elements around it
    text: str
    links: int           # characters in links
    apart: bool          # inside an element that holds no main text
    article: bool
    main: bool
    doubt: bool          # a class word sets apart what is around the article or main part it is in, or the block itself
    inner: bool          # a class word sets apart something inside that article or main part
    at: int = 0          # start tags before its end


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    tags: list[int] = field(default_factory=list)  # hash of each start tag with the elements around it
    article: bool = False  # whether it marks an article, or else the main part, even an empty one
    main: bool = False


@dataclass
class _Open:
    name: str
    path: int
    apart: bool = False
    article: bool = False
    main: bool = False
    link: bool = False
    doubt: bool = False
    inner: bool = False


class _Stack:
    """Open elements, with the places of each name, so that looking one up costs the same at any depth."""

    def __init__(self) -> None:
        self.items = [_Open("", 0)]
        self.places: dict[str, list[int]] = {}
        self.holders = [0]  # places of the elements that tell blocks of text apart

    @property
    def top(self) -> _Open:
        return self.items[-1]

    def holder(self) -> _Open:
        """The innermost block element that is open; inline elements left open don't tell blocks apart."""
        return self.items[self.holders[-1]]

    def push(self, element: _Open) -> None:
        self.places.setdefault(element.name, []).append(len(self.items))
        if element.name in BLOCK or element.apart:
            self.holders.append(len(self.items))
        self.items.append(element)

    def pop(self, to: int) -> None:
        """End the elements from a place on."""
        while len(self.items) > to:
            self.places[self.items.pop().name].pop()
        while self.holders[-1] >= to:
            self.holders.pop()

    def innermost(self, names) -> int:
        """The place of the innermost open element among ``names``; 0 if there is none."""
        found = 0
        for name in names:
            places = self.places.get(name)
            if places and places[-1] > found:
                found = places[-1]
        return found

    def close(self, names, limits=()) -> None:
        """End the innermost open element among ``names``, unless one of ``limits`` is open inside it."""
        if self.items[-1].name in names:
            self.pop(len(self.items) - 1)
            return
        at = self.innermost(names)
        if at > self.innermost(limits):
            self.pop(at)


def parse(source: str) -> Page:
    """Blocks of text and start tags in page order. Never fails: what is no markup is text."""
    page, stack = Page(), _Stack()
    pieces: list[str] = []
    state = {"links": 0}

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                top = stack.holder()
                page.blocks.append(Block(top.path, text, state["links"], top.apart, top.article, top.main, top.doubt, top.inner, len(page.tags)))
        state["links"] = 0

    def add(raw: str) -> None:
        if raw:
            text = references.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if stack.top.link:
                state["links"] += len(text.strip())

    at, size, last = 0, len(source), source.rfind(">")
    while at < size:
        lt = source.find("<", at)
        if lt < 0:
            add(source[at:])
            break
        add(source[at:lt])
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if source.startswith(("<!", "<?"), lt):
            end = source.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        tag = _TAG.match(source, lt) if lt < last else None
        if not tag:
            end = source.find(">", lt) if lt < last and re.match(r"</?[A-Za-z]", source[lt:lt + 3]) else -1
            if end < 0:
                add("<")
                at = lt + 1
            else:
                at = end + 1  # a tag whose quotes don't close
            continue
        at, name = tag.end(), tag[2].lower()
        if tag[1]:
            if name in BLOCK:
                flush()
            if name == "br":
                add(" ")
            stack.close((name,))
            continue
        if name in RAW:
            if not tag[3].rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(source, at)
                end = source.find(">", close.start()) if close else -1
                at = size if end < 0 else end + 1
            continue
        if name in BLOCK:
            flush()
        if name == "br":
            add(" ")
        attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(tag[3])} if tag[3] else {}
        if name in ENDS_PARAGRAPH:
            stack.close({"p"}, {"article", "main", "section", "div", "td", "th", "li", "blockquote"})
        if name in SELF_ENDING:
            stack.close(SELF_ENDING[name], {"ul", "ol", "dl", "table", "select", "menu"})
        if name in ("article", "main"):  # left open before it: no page puts its article there
            while stack.top.apart and stack.top.name in ("nav", "header", "form", "p", "a", "b", "ul", "li"):
                stack.pop(len(stack.items) - 1)
        top = stack.top
        own = attributes.get("class", "").lower()
        path = xxhash.xxh64_intdigest(f"{top.path}/{name}.{own}")
        page.tags.append(path)
        if name not in VOID:
            apart = top.apart or _set_apart(name, attributes)
            article = name == "article" and not apart
            main = name == "main" or attributes.get("role", "").lower() == "main"
            word = name not in WHOLE and _named(attributes)[1]
            within = top.article or top.main
            doubt, inner = top.doubt or word and not within, top.inner or word and within
            page.article, page.main = page.article or article and not (doubt or inner), page.main or main and not doubt
            stack.push(_Open(name, path, apart, top.article or article, top.main or main, top.link or name == "a", doubt, inner))
    flush()
    return page


def text_token(block: Block) -> int:
    """An odd number; a start tag's token is even."""
    return xxhash.xxh64_intdigest(f"{block.path}#{block.text}") | 1


def _token_blocks(page: Page) -> list[Block]:
    """Blocks that are tokens: all but those that markup sets apart."""
    return [b for b in page.blocks if not (b.apart or b.doubt or b.inner)]


def sequence(page: Page, blocks: list[Block]) -> np.ndarray:
    """The page's tokens in order, as signed numbers."""
    tokens, at = [0], 0
    for block in blocks:
        tokens += page.tags[at:block.at]
        tokens.append(text_token(block))
        at = block.at
    tokens += page.tags[at:]
    out = np.array(tokens, np.uint64)
    texts = np.zeros(len(out), bool)
    texts[[1 + b.at + i for i, b in enumerate(blocks)]] = True
    return np.where(texts, out, out & ~np.uint64(1)).view(np.int64)


def _marked(blocks: list[Block]) -> list[Block]:
    """Blocks of an article or main part without what class words set apart in it, unless that is all."""
    return [b for b in blocks if not b.inner] or blocks


def _article(page: Page, linked: frozenset[int] = frozenset()) -> list[Block]:
    """``linked``: the ``id`` of blocks in slots that hold hardly more than links all over the host."""
    blocks = [b for b in page.blocks if not b.apart]
    plain = [b for b in blocks if not b.doubt]
    if page.article:
        return _marked([b for b in plain if b.article])
    if page.main:
        return _marked([b for b in plain if b.main])
    rest = [b for b in plain if not b.inner and b.links <= LINK_SHARE * len(b.text)]
    rest = [b for b in rest if id(b) not in linked] or rest
    marked = _marked([b for b in blocks if b.article]) or _marked([b for b in blocks if b.main])
    return max(rest, marked, key=lambda some: sum(len(b.text) for b in some))


def _linked(page: Page, layout: Layout) -> frozenset[int]:
    """The ``id`` of blocks that lie in the host's link slots."""
    if not layout.link_slots:
        return frozenset()
    blocks = _token_blocks(page)
    tokens = sequence(page, blocks).tolist()
    own = [b for b, token in zip(blocks, (t for t in tokens if t & 1)) if token not in layout.code]
    return frozenset(id(b) for b, slot in zip(own, layout.walk(layout.lay(tokens))[0]) if slot in layout.link_slots)


def main_text(page: Page, template: frozenset[int], layout: Layout | None = None) -> str:
    """Blocks in the slots of the template that belong to the article, joined by empty lines.

    The article is what stands in ``article`` elements, else in ``main``, else
    in the slots of the host's template that hold more than links, without
    blocks that are mostly links. Class words set elements apart, but never a whole article: where all ``article`` and
    ``main`` elements bear such a word or stand in an element that does, they
    are the article if they hold more text than the rest of the page, and
    where all text of an article stands in such elements, it stays.
    """
    linked = _linked(page, layout) if layout else frozenset()
    return "\n\n".join(b.text for b in _article(page, linked) if not (template and text_token(b) in template))


# -- Spark ---------------------------------------------------------------------------------------------------------
def templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, columns of MODEL): the classes and slots of each host's template.

    A token is a start tag or a block of text, each with the elements around
    it. For every host, tokens with one occurrence vector (how often each in
    every different page) are a class; a class is looked at if it is in
    TEMPLATE_SHARE of a host's different pages. With a constant count in those
    its texts are template; with a changing one, as in rows of a list, they are if
    the class has further tokens, is ordered and nested. The slots lie between the tokens of ordered and
    nested classes. Texts of any length count, by their hash; pages without
    text and tags don't. Hosts with fewer than LEAST_PAGES different pages
    have no template.
    """

    def each(batches, names):
        for batch in batches:
            rows = []
            for name, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = parse(source)
                if not page.blocks and not page.tags:
                    continue
                blocks = _token_blocks(page)
                tokens = sequence(page, blocks)
                rows.append((name, xxhash.xxh64_intdigest(source) - (1 << 63), tokens, [len(b.text) for b in blocks],
                             [b.links for b in blocks], *np.unique(tokens, return_counts=True)))
            if rows:
                yield batch_of(names, list(zip(*rows)))

    seen = map_batches(pages, [host(F.col(url)).alias("host"), text_or_empty(html)], each, PAGES)
    once = stored(seen.dropDuplicates(["host", "page"]), "page-tokens")  # copies of a page count once
    return deduce(once, LEAST_PAGES, TEMPLATE_SHARE, LINK_SLOT_SHARE)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every row: the main text of the whole page, see ``main_text``.

    A null page is empty and gives an empty text; pages without a usable
    address are one host; repeated rows are kept.
    """
    kind = pages.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, url string, text string, n_chars bigint"

    found = stored(templates(pages, url, html), "templates")
    rows = (pages.select(F.col(key).alias("__key"), F.col(url).cast("string").alias("__url"), text_or_empty(html).alias("__html"),
                         host(F.col(url)).alias("host"))
            .join(found, "host", "left"))

    def each(batches, names):
        for batch in batches:
            out = []
            for layout, k, link, source in zip(layouts_of(batch, 4), *(batch.column(i).to_pylist() for i in (1, 2, 3))):
                template = layout.text_ids if layout else frozenset()
                text = main_text(parse(source), template, layout)
                out.append((k, link, text, len(text)))
            yield batch_of(names, list(zip(*out)))

    return map_batches(rows, ["host", "__key", "__url", "__html", *MODEL], each, schema)
