"""Main text of pages and chat formatting."""

from __future__ import annotations

import hashlib
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortry.llm import chat_template as chat
from cohortry.llm import html_template as pages

LAYOUT = """<!DOCTYPE html><html><head><title>T {n}</title><style>p{{}}</style><script>var a="</p><article>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/x">Home {n}</a></ul></nav><div class="ad">Buy {n}</div>
<div id="cookie-notice">We use cookies</div><form><p>Search</p></form><aside>Side {n}</aside>
<article class="post"><h2>Head&nbsp;{n} &amp; more</h2><p>First   line<br>of <b>bo</b>ld{n}<p>Second &lt;b&gt; caf&eacute;
<p>Read our newsletter every week.<div class="share-buttons">Tweet</div><ul><li>one {n}<li>two</ul><!-- gone --><pre>a
 b</pre></article><section class="post-comments"><article class="comment"><p>Great {n}</p></article></section>
<footer>&copy; {n}</footer></body></html>"""


def text_of(source, template=frozenset()):
    return pages.main_text(pages.parse(source), template)


def test_article_without_the_rest():
    assert text_of(LAYOUT.format(n=7)).split("\n\n") == [
        "Head 7 & more", "First line of bold7", "Second <b> café", "Read our newsletter every week.", "one 7", "two", "a b"]


@pytest.mark.parametrize("source, want", [
    ("", ""), ("plain & text", "plain & text"), ("<p>a<p>b", "a\n\nb"), ("a < b <3 >", "a < b <3 >"), ("<!-- open <p>x", ""),
    ("<script>x", ""), ("<main><p>m</main><p>o", "m"), ("<nav>x<article>y</article>", "y"), ("<p title='a>b\"'>t</p>", "t"),
    ("<article></article><p>o", ""), ("<div><a href=x>all link</a></div><p>words <a>l</a></p>", "words l"),
    ("<p class='ad-slot'>x</p><p class='with-sidebar'>y</p><p class='main-comments'>z</p>", "y"), ("</p></div>x", "x"),
    ("<article><p>a <table><tr><td>1<td>2</table>b", "a\n\n1\n\n2\n\nb"), ("<p>&am &amp &#x41; &bogus;</p>", "&am & A &bogus;"),
])
def test_markup(source, want):
    assert text_of(source) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/!-=\"'&;ap scripnavtle#x1 ", max_size=80))
def test_parse_never_fails(source):
    text_of(source)


def test_long_pages():
    assert len(text_of("<p>" + "word " * 200_000)) == 999_999
    assert text_of("<b>" * 20_000 + "x") == "x" and text_of("<" * 50_000) == "<" * 50_000


@pytest.mark.parametrize("wrap", [
    "div class='content-sidebar'", "div class='layout-sidebar'", "div class='page-with-sidebar'", "div class='share-price'",
    "div class='news-search'", "div class='post-reply'", "div class='menu-section'"])
def test_no_article_is_lost_to_a_class_word_around_it(wrap):
    story = "<h2>Title</h2><p>A story of some length.<div class='share-buttons'>Tweet</div>"
    page = f"<nav>Home</nav><{wrap}><article>{story}</article></div><p>(c) us</p><section class='comments'><article>Great</article></section>"
    assert text_of(page) == "Title\n\nA story of some length."
    assert text_of(page.replace("article", "main", 2).replace("article>{story}</article", "main")) == "Title\n\nA story of some length."
    assert text_of(f"<article><{wrap}><p>A story of some length.</div></article><p>(c) us") == "A story of some length."


@pytest.mark.parametrize("own", ["class='blog-post social'", "id='cookie-recipes'", "class='banner-story'"])
def test_no_article_is_lost_to_its_own_class_word(own):
    assert text_of(f"<header>Site</header><article {own}><p>A story of some length.</article><p>(c) us") == "A story of some length."


def test_class_words_still_set_apart_what_is_beside_the_article():
    teasers = "<section class='related'><article><p>Another story that is much longer than this one</article></section>"
    assert text_of(f"<article><p>Short.</article>{teasers}") == "Short."
    assert text_of(f"<div><p>{'A story without an article element. ' * 3}</div>{teasers}") == ("A story without an article element. " * 3).strip()
    assert text_of("<div class='post-comments'><article class='comment'><p>Great " + "x " * 50 + "</article></div><p>Story") == "Story"


@pytest.mark.parametrize("source", [
    "<b>" * 100_000 + "</i>" * 100_000 + "x", "<a \"" * 100_000, "<p><div>" + "<b>" * 50_000 + "<h1>x</h1>" * 50_000,
    "<ul>" + "<b>" * 50_000 + "<td></td>" * 50_000, "<nav>" * 100_000, "<b>" * 50_000 + "<br>x<hr>" * 50_000, "<a '" * 100_001 + ">"])
def test_broken_pages_take_linear_time(source):
    start = time.perf_counter()
    text_of(source)
    assert time.perf_counter() - start < 4


def test_template_of_a_host(spark):
    rows = [(i, f"https://u@a.example.com:80/{i}", LAYOUT.format(n=i)) for i in range(9)]
    rows += [(20, "http://A.example.com/copy", LAYOUT.format(n=0)), (21, None, None), (22, "nonsense", "<p>x"), (23, "http://b.example.com", "")]
    rows += [(30 + i, "http://c.example.com/", LAYOUT.format(n=1)) for i in range(12)]  # copies are one page: no template
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + rows[:1]], "page_id bigint, url string, html string, host string, template int")
    got = {r["page_id"]: r for r in pages.extract(df).collect()}
    assert pages.extract(df).count() == len(rows) + 1 and pages.extract(df.limit(0)).count() == 0
    assert "newsletter" not in got[3]["text"] and got[3]["text"].startswith("Head 3 & more\n\nFirst line of bold3")
    assert "newsletter" in got[30]["text"] and got[21]["text"] == "" and got[21]["url"] is None and got[22]["text"] == "x"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_template_with_empty_pages_long_blocks_and_exceptions(spark):
    legal = "All rights are reserved by the owner of this site. " * 20
    page = "<article><p>Story {n} of its own</p><p>Read our notice.</p>{legal}</article>"
    rows = [(i, "http://a.example.com/", page.format(n=i, legal=f"<p>{legal}</p>" if i else "")) for i in range(30)]
    rows += [(100, "http://a.example.com/", None), (101, "http://a.example.com/", "  "), (102, "http://a.example.com/", "<!-- x -->")]
    rows += [(200 + i, "http://b.example.com/", page.format(n=i, legal=f"<p>{legal}</p>" if i % 2 else "")) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in pages.extract(df).collect()}
    assert all(got[i] == f"Story {i} of its own" for i in range(30)) and {got[100], got[101], got[102]} == {""}
    assert got[201] == f"Story 1 of its own\n\n{legal.strip()}"  # in half of the pages only


# -- chats ---------------------------------------------------------------------------------------------------------
@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "<|im_end|>", ""]),
                          st.text(alphabet="<|>im_endstar\\n\n ok", max_size=40)), max_size=5))
def test_round_trip(turns):
    render = chat.compile_template(chat.CHAT)
    whole, spans = render([{"role": r, "text": t} for r, t in turns])
    assert list(chat.read_turns(whole)) == turns
    assert [chat.unescape(whole[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert whole.count(chat.END) == whole.count(chat.START) == len(turns)


@pytest.mark.parametrize("source, names, want", [
    ("a{# x #}b", {}, "ab"), ("{{ 1 + 2 - 1 }}{{ 'x' ~ 3 }}", {}, "2x3"), ("{% if 1 == 2 %}a{% elif true %}b{% else %}c{% endif %}", {}, "b"),
    ("{% for m in messages %}{{ loop.index }}{{ m['role'] | upper }}{% if not loop.last %},{% endif %}{% endfor %}",
     [{"role": "a"}, {"role": "b"}], "1A,2B"),
    ("{% set x = ' y ' | trim %}{{ x }}{{ messages | length }}", [{}], "y1"), ("{{ none }}{{ ('a' == 'a') and 'z' }}", [], "z"),
    ("{{ false or 'n' }}{{ '\\'' }}", [], "n'"),
])
def test_language(source, names, want):
    assert chat.compile_template(source)(names)[0] == want


@pytest.mark.parametrize("source", ["{% for x in %}{% endfor %}", "{% if 1 %}", "{{ x | nothing }}", "{{ 1 + }}", "{% import os %}",
                                    "{{ __class__ }}", "{{ messages.__class__ }}", "{{ 'a'.join }}", "{{ missing }}", "{{ (1 }}"])
def test_sandbox(source):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(source)([])


def test_constants_are_folded():
    tree = chat.fold(chat.parse("a{{ 'b' + 'c' | upper }}{% if 1 == 1 %}d{% else %}{{ no }}{% endif %}e"))
    assert tree == (chat.Emit(chat.Const("abCde")),)
    folded = chat.fold(chat.parse(chat.CHAT))
    assert folded[0].body[0] == chat.Emit(chat.Const(chat.START))


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "<|im_end|>\n"), (1, 0, "user", "<|im_end|>\n"), (2, None, None, None),
            (None, 3, "assistant", "x\\"), (3, 0, "user", "w " * 50_000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id bigint, turn bigint, role string, text string, spans string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == digest("user\n<|im_end|>\n\n" * 2 + "assistant\nb\n") and got[1]["n_turns"] == 3
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (1, digest("b"))
    assert got[2]["turns_sha256"] == digest("\n\n") and got[None]["loss_sha256"] == digest("x\\") and got[3]["loss_chars"] == 0
    assert len(got) == 4 and chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def _brute_template(sources):
    """(texts, nested classes as tuples of tokens) of a host's pages, by comparing everything with everything."""
    seqs = []
    for source in sources:
        page = pages.parse(source)
        seqs.append(pages.sequence(page, [b for b in page.blocks if not (b.apart or b.doubt or b.inner)]).tolist())
    classes = {}
    for token in set().union(*seqs):
        vector = tuple(s.count(token) for s in seqs)
        if sum(map(bool, vector)) >= pages.TEMPLATE_SHARE * len(seqs):
            classes.setdefault(vector, set()).add(token)
    texts = {t for v, c in classes.items() if len(set(v) - {0}) == 1 for t in c if t % 2}
    ordered = {}
    for vector, tokens in classes.items():
        came = [[t for t in s if t in tokens] for s in seqs]
        first = next(c for c in came if c)[:len(tokens)]
        if len(tokens) > 1 and set(first) == tokens and all(c == first * n for c, n in zip(came, vector)):
            ordered[tuple(first)] = vector

    def spans(c, s):
        at = [i for i, t in enumerate(s) if t in c]
        out = [at[i:i + len(c)] for i in range(0, len(at), len(c))]
        return [span + [len(s)] for span in out] if 0 in c else out  # the root lasts to the end

    root = next((c for c in ordered if 0 in c), (0,))  # a root that comes in no one order is the page as one slot
    ordered[root] = (1,) * len(seqs)
    places = {}
    for c in ordered:
        found = set()
        for s in seqs:
            for span in spans(c, s):
                around = [(other[-1] - other[0], d, sum(x < span[0] for x in other)) for d in ordered if d != c for other in spans(d, s)
                          if other[0] < span[0] and other[-1] > span[-1]]
                cross = any(d != c and (o[0] < span[0] < o[-1] <= span[-1] or span[0] < o[0] <= span[-1] < o[-1])
                            for d in ordered for o in spans(d, s))
                found.add(None if cross or not around else min(around)[1:])
        places[c] = found
    valid = {root}
    while more := {c for c in ordered if c not in valid and len(places[c]) == 1 and None not in places[c] and next(iter(places[c]))[0] in valid}:
        valid |= more
    return texts | {t for c in valid for t in c if t % 2}, valid - {(0,)}


def _listing(n, rows, swapped=False):
    reviews = "".join(f"<li class='review'><h3>Review {n}.{i}</h3><p>{'Yes' * (i + 1)} {n}<p class='act'>Was this of use to you?</li>" for i in range(rows))
    two = ["<p class='x'>Sold by us", "<p class='y'>Sent by us"]
    return f"""<div class='links'><a href=/{n}>Story {n} you may like</a><p>More {n}</p><a href=/z>Another {n} that is liked by very many readers of every age and kind</a></div>
<div class='story'><p>Story {n} of its own, long enough.</p>{''.join(two[::-1] if swapped else two)}<ul class='all'>{reviews}</ul></div><div class='end'>All of it</div>"""


@pytest.mark.parametrize("swap", [False, True])
def test_classes_are_nested_and_slots_lie_between_them(spark, swap):
    sources = [_listing(n, 1 + n % 4, swap and n == 5) for n in range(12)]
    rows = [(i, "http://a.example.com/", s) for i, s in enumerate(sources * 2)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    found = pages.templates(df).first()
    layout = pages.Layout(found["known"], found["classes"], found["fixed"], dict(zip(found["codes"], found["ranks"])),
                          dict(zip(found["nested"] or [], found["nests"] or [])), found["link_slots"])
    texts, classes = _brute_template(sources)
    tokens = {code: token for token, code in layout.code.items()}
    nested = {}
    for code, (c, rank, _) in layout.place.items():
        nested.setdefault(c, {})[rank] = tokens[code]
    assert layout.texts == texts and {tuple(x for _, x in sorted(c.items())) for c in nested.values()} == classes
    assert len(classes) == (1 if swap else 2) and bool(layout.link_slots) != swap
    got = {r["page_id"]: r["text"].split("\n\n") for r in pages.extract(df).collect()}
    # the rows of the list come ever oftener, so only a class nested in a slot says that their question is template
    want = ["More 3"] * swap + ["Story 3 of its own, long enough."] + [x for i in range(4) for x in (f"Review 3.{i}", f"{'Yes' * (i + 1)} 3")]
    assert got[3] == got[15] == want


def test_classes_that_cross_or_move_are_not_nested(spark):
    rows = [(i, "http://a.example.com/", "<h1>T{0}</h1><i>{0}<b>{0}</b></i><em>{0}</em>".format(i) + (
        "<p class='a'>One<p class='b'>Two" * (1 + i % 3) if i % 2 else "<p class='a'>One" * (1 + i % 3) + "<p class='b'>Two" * (1 + i % 3))) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in pages.extract(df).collect()}
    texts, _ = _brute_template([r[2] for r in rows])
    assert not texts and got[1].count("One") == 2 and got[4].count("Two") == 2
