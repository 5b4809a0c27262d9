"""Secret scan and benchmark decontamination."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import string

import numpy as np
import pytest

from cohortry.llm import decontaminate, secrets
from tests.llm import brute
from tests.llm.test_near_duplicates import prose

KEY = "Zk3fQ9xT1bVn7LpR0wYc5HsGu8JdEa2MoXi6KqBt"


@pytest.fixture(scope="module")
def scanned():
    draw = random.Random(5)
    syllables = ["the", "ing", "tion", "er", "an", "re", "on", "at", "en", "nd"]
    ordinary = lambda: " ".join("".join(draw.choice(syllables) for _ in range(draw.randint(1, 9))) for _ in range(200))
    rows = [(i, ordinary(), 0) for i in range(60)]
    rows += [(100, None, 0), (101, "", 0), (102, 'Token = "abc" PASSWORD:hunter22 secret=token=xyzxyz api_key : 12', 0),
             (103, "é AKIA" + "A1B2" * 5 + " xAKIAshort 0123456789abcdef01234567", 0),
             (104, f"before {KEY} after", 0), (105, "=" * 40 + " " + "z" * 50, 0), (106, f"ſecret=abcdefgh tokenK=abcdefg {KEY}=", 0),
             (107, "token=" + "a" * 30000, 0), (None, "password=abcdefghi", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, scanned):
    return spark.createDataFrame(scanned, "doc_id bigint, text string, n_chars int").repartition(3)


def test_base_spans_equal_brute_force(docs, scanned):
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(docs)).collect()}
    assert len(got) == len(scanned)
    for i, t, _ in scanned:
        spans = brute.base_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(secrets.joined(spans).encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in brute.KINDS] == [sum(s[0] == k for s in spans) for k in brute.KINDS]
        assert [s for s in got[i]["spans"].split(",") if s and not s.startswith("random")] == [f"{k}:{a}:{b}" for k, a, b in spans]
    assert got[104]["spans"] == f"random:7:{7 + len(KEY)}" and got[105]["spans"] == ""
    assert sum(got[i]["n_random"] for i in range(60)) == 0


def test_redaction(docs, scanned):
    clean = secrets.redact(docs, length="n_chars")
    assert clean.columns == docs.columns
    got = {r["doc_id"]: r for r in clean.collect()}
    assert got[104]["text"] == "before [SECRET] after" and got[104]["n_chars"] == 21
    assert got[100]["text"] is None and got[100]["n_chars"] == 0
    assert got[5]["text"] == scanned[5][1] and got[None]["text"] == "[SECRET]"


def test_secrets_beside_other_signs(spark, scanned):
    aws = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzEXAMPLEKq"
    hexes = "0123456789abcdef01234567"
    cases = {
        200: (f"AWS_SECRET_ACCESS_KEY={aws} x", aws), 201: (f"auth={KEY}", KEY), 202: (f"a?sig={KEY}&x=1", KEY),
        203: (f"first={KEY}==&and={aws}", f"{KEY} {aws}"), 204: (f"https://example.com/the/thing/{KEY}", KEY),
        205: (f"the-thing-on-the-{KEY}", KEY), 206: (f"the_thing_{KEY}_the", KEY), 207: (f"{hexes}{KEY}", KEY[0:]),
    }
    rows = scanned + [(i, text, 0) for i, (text, _) in cases.items()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars int").repartition(3)
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(docs)).collect()}
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    for i, (text, want) in cases.items():
        spans = [tuple(map(int, s.split(":")[1:])) for s in got[i]["spans"].split(",") if s.startswith("random")]
        assert all(any(text[a:b].find(one) >= 0 for a, b in spans) for one in want.split()), (text, spans)
        assert all(one not in clean[i] for one in want.split())
    assert clean[201] == "auth=[SECRET]" and clean[204].startswith("https://example.")
    assert sum(got[i]["n_random"] for i in range(60)) == 0


def test_pieces_of_runs():
    a, b = "a" * 20, "B" * 25
    tokens = lambda text, spans=(): [t for _, _, t in secrets.candidates(text, spans)]
    assert tokens(f"{a}={b}==") == [a, b] and tokens(f"{a}=x") == [a] and tokens("x" * 19 + "=") == []
    assert sorted(tokens(f"/{a}-x/{b}")) == sorted([f"/{a}-x/{b}", f"{a}-x", a, b])
    assert tokens(f"{a}{b}{a}", [("hex", 20, 45)]) == [a, a] and tokens(f"{a}{b}", [("hex", 0, 30), ("assign", 10, 20)]) == []


def test_outermost_equals_brute_force():
    draw = random.Random(8)
    for _ in range(200):
        cuts = sorted(draw.sample(range(60), 8))
        ranges = list(set(zip(cuts, cuts[1:]))) + [(cuts[i], cuts[i + 2]) for i in draw.sample((0, 2, 4), draw.randint(0, 3))]
        draw.shuffle(ranges)
        want = {r for r in ranges if not any(o != r and o[0] <= r[0] and o[1] >= r[1] for o in ranges)}
        assert {ranges[i] for i in secrets.outermost(ranges)} == want
    assert secrets.outermost([]) == [] and len(secrets.outermost([(1, 5), (1, 5)])) == 1


def test_random_spans_equal_brute_force(spark, scanned):
    draw = random.Random(4)
    token = lambda n, signs: "".join(draw.choice(signs) for _ in range(n))
    rows = [(i, t) for i, t, _ in scanned] + [(700 + i, f"{t.upper()} IN 2024 AND 1999 OF 15 300") for i, t, _ in scanned[:20]]
    rows += [(300 + i, f"at {token(30, string.ascii_letters)} and /the/{token(44, string.ascii_letters + string.digits)}-the_thing/"
              f"{token(26, string.ascii_uppercase + '234567')} é {token(32, '0123456789ABCDEF')}") for i in range(40)]
    pairs = np.zeros((secrets.OTHER + 1, secrets.OTHER + 1), np.int64)
    every, blank = {}, secrets.Battery(np.zeros((secrets.OTHER + 1) ** 2, np.int64))
    for i, text in rows:
        text = text or ""
        base = secrets.base_spans(text)
        every[i] = (base, secrets.candidates(text, base))
        hidden = set()
        for a, b in [s[1:] for s in base] + [c[:2] for c in every[i][1] if blank.drawn_evenly(c[2])]:
            hidden |= set(range(a, b))
        signs = [None if at in hidden else c for at, c in enumerate(text)]
        for x, y in zip(signs, signs[1:]):
            if x and y and x in secrets.SIGNS and y in secrets.SIGNS:
                pairs[secrets.SIGNS.index(x), secrets.SIGNS.index(y)] += 1
    battery = secrets.Battery(pairs)
    grades = [(secrets.length_bin(len(t)), battery.grade(t)) for _, found in every.values() for _, _, t in found]
    least = secrets.thresholds([(b, g, grades.count((b, g))) for b, g in set(grades)])
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r["spans"] for r in secrets.digest(secrets.scan(df)).collect()}
    flagged = 0
    for i, (base, found) in every.items():
        hits = {(a, b) for a, b, t in found if battery.grade(t) >= least.get(secrets.length_bin(len(t)), 10 ** 9)}
        hits = {h for h in hits if not any(o != h and o[0] <= h[0] and o[1] >= h[1] for o in hits)}
        flagged += len(hits)
        order = sorted(base + [("random", a, b) for a, b in hits], key=lambda s: (s[1], secrets.KINDS.index(s[0]), s[2]))
        assert got[i] == secrets.joined(order), i
    assert flagged >= 100  # the little ordinary text here tells upper-case hex from words only now and then


def test_many_secrets_are_found_and_spoil_no_others(spark, scanned):
    draw = random.Random(6)
    key = lambda: "".join(draw.choice(string.ascii_letters + string.digits) for _ in range(40))
    rows = [(i, t) for i, t, _ in scanned] + [(500, " ".join(f"the thing {key()} on the" for _ in range(8000))), (501, f"one {key()} more")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r["n_random"] for r in secrets.digest(secrets.scan(df)).collect()}
    assert got[500] >= 7600 and got[501] == 1 and sum(got[i] for i in range(60)) == 0


def test_text_without_its_ranges():
    assert secrets.without("abcdef", []) == "abcdef" and secrets.without("abcdef", [(0, 2), (4, 6)]) == " cd "
    assert secrets.apart([(4, 6), (0, 2), (1, 3), (6, 7)]) == [(0, 3), (4, 7)] and secrets.apart([]) == []


def test_empty_table(docs):
    assert secrets.digest(secrets.scan(docs.limit(0))).count() == 0
    assert secrets.redact(docs.limit(0)).count() == 0


def test_battery_tells_random_from_even_and_repeated():
    battery = secrets.Battery(np.zeros((secrets.OTHER + 1) ** 2, np.int64))
    draw, alphabet = random.Random(2), string.ascii_letters + string.digits
    passed = sum(battery.looks_random(np.array([alphabet.index(draw.choice(alphabet)) for _ in range(40)]), 62) for _ in range(300))
    assert passed >= 295  # each test rejects one random string in a thousand
    assert not battery.looks_random(np.zeros(40, np.int64), 62)
    assert not battery.looks_random(np.arange(40) % 2 * 50, 62)
    assert not battery.looks_random(np.arange(62), 62)


def test_false_discovery_control():
    rows = [(20, 0, 1000), (20, 400, 5), (20, 100, 10), (32, 200, 1)]
    least = secrets.thresholds(rows)
    assert least == {20: 400, 32: 200}
    assert secrets.thresholds([(20, 10, 3)]) == {} and secrets.thresholds([]) == {}


@pytest.fixture(scope="module")
def bench():
    items = [(i, prose(900 + i, n)) for i, n in enumerate((60, 35, 22, 15, 9, 8, 6, 5, 4, 1))]
    return items + [(20, items[0][1]), (30, None), (31, ""), (None, items[1][1]), (32, "--- !!")]


@pytest.fixture(scope="module")
def corpus(bench):
    draw, texts = random.Random(4), {i: t for i, t in bench if i is not None}
    rows = [(i, prose(2000 + i, 100)) for i in range(20)]
    for i in range(8):
        rows.append((100 + i, f"{prose(3000 + i, 50)} {texts[i]}, {prose(4000 + i, 30)}"))
    changed = texts[0].split()
    for place in (6, 15, 24, 33, 42, 51):
        changed[place] = "replaced"
    rows += [(200, " ".join(changed).upper()), (201, " ".join(texts[0].split()[10:35])), (202, " ".join(texts[0].split()[10:20])),
             (203, " ".join(texts[1].split()[::-1])), (204, None), (205, ""), (206, texts[0] + " " + texts[0])]
    draw.shuffle(rows)
    return rows


def test_overlaps_equal_brute_force(spark, corpus, bench):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in corpus], "doc_id bigint, text string, words string, seed int")
    items = spark.createDataFrame(bench, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs.unionByName(docs.limit(3)), items).collect()}
    want = brute.overlaps(corpus, [(i, t) for i, t in bench if i is not None and i <= 7])
    assert got == want
    assert {(200, 0), (201, 0), (206, 0)} <= got and not any(d in (202, 203) for d, _ in got)
    clean = decontaminate.clean(docs, items)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in corpus} - {d for d, _ in want}


def test_masks_hit_every_pattern():
    for n in range(5, decontaminate.WINDOW + 1):
        masks = [m for m, low, high in decontaminate.MASKS if low <= n <= high]
        laid = [int(m, 2) << k for m in masks for k in range(n - len(m) + 1)]
        for gone in itertools.combinations(range(n), n - math.ceil(n * decontaminate.SHARE)):
            equal = (1 << n) - 1 - sum(1 << k for k in gone)
            assert any(m & equal == m for m in laid), (n, gone)


def test_replaced_words_of_items_of_any_length(spark):
    items, docs = [], []
    for n in (5, 6, 7, 8, 9, 10, 15, 20):
        words = [f"w{n}x{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        most = n - math.ceil(n * decontaminate.SHARE)
        patterns = list(itertools.combinations(range(n), most))
        patterns = patterns if len(patterns) <= 60 else random.Random(n).sample(patterns, 60)
        if n == 20:
            patterns.append((6, 8, 11, 16))  # places 7, 9, 12 and 17
        for p in patterns:
            docs.append((len(docs), " ".join("other" if k in p else w for k, w in enumerate(words))))
        docs.append((len(docs), " ".join("other" if k <= most else w for k, w in enumerate(words))))  # one too many
    of = lambda chosen: {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(chosen, "item_id bigint, text string")).collect()}
    want = {(d, i) for d, t in docs for i, u in items
            if sum(a == b for a, b in zip(t.split(), u.split())) >= 0.8 * len(u.split()) == 0.8 * len(t.split())}
    got = of(items)
    assert got == want and len(want) == len(docs) - len(items)
    assert of(items[-1:]) == {(d, i) for d, i in want if i == 20}  # shorter items make no difference


def test_decontamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, prose(1, 40)), (None, prose(2, 30))], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, prose(2, 30))], "item_id bigint, text string")
    assert decontaminate.overlaps(docs, items).count() == 0  # a null key is not reported
    assert decontaminate.clean(docs, items).count() == 2
    assert decontaminate.overlaps(docs, items.limit(0)).count() == 0
    assert decontaminate.clean(docs.limit(0), items).count() == 0


def test_no_python_in_the_plan(spark, corpus, bench):
    docs = spark.createDataFrame(corpus, "doc_id bigint, text string")
    plan = decontaminate.overlaps(docs, spark.createDataFrame(bench, "item_id bigint, text string"))
    assert "Python" not in plan._jdf.queryExecution().toString()
