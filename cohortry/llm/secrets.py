"""Secret scan: fixed patterns, and a battery of randomness tests with false-discovery control."""

from __future__ import annotations

import bisect
import functools
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import ROWS_AT_ONCE, batch_of, map_batches, stored, text_or_empty

# The base patterns, their kinds in order, and the least number of characters.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "random")

CANDIDATE_LENGTH = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % CANDIDATE_LENGTH)
CUTS = tuple(re.compile(r"[A-Za-z0-9%s]{%d,}" % (signs, CANDIDATE_LENGTH)) for signs in ("+/_-", "+_-", "+"))
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
OTHER = len(SIGNS)
LENGTH_BINS = (20, 24, 32, 48, 80)   # false discoveries are controlled in each bin of its own
FALSE_DISCOVERIES = 0.001            # share of ordinary strings among those flagged
RANDOM_LEVEL = 0.001                 # each test must not reject randomness at this level
GRID = 50                            # steps of the p-value grid for each power of ten
GRID_END = 60 * GRID

# Encodings from narrow to wide: a string has the first one that holds all its signs.
UPPER, LOWER, DIGITS = SIGNS[:26], SIGNS[26:52], SIGNS[52:62]
ENCODINGS = (
    ("decimal", DIGITS), ("hex", DIGITS + LOWER[:6]), ("HEX", DIGITS + UPPER[:6]), ("base32", UPPER + "234567"),
    ("lower", LOWER), ("upper", UPPER), ("lower36", DIGITS + LOWER), ("upper36", DIGITS + UPPER),
    ("base62", DIGITS + UPPER + LOWER), ("base64", DIGITS + UPPER + LOWER + "+/"),
    ("base64url", DIGITS + UPPER + LOWER + "_-"), ("any", SIGNS),
)
_CODE = np.full(256, OTHER, np.int64)
_CODE[np.frombuffer(SIGNS.encode(), np.uint8)] = np.arange(OTHER)
_KIND_OF_SIGN = np.array([0] * 26 + [1] * 26 + [2] * 10 + [3] * 4)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, in code points."""
    spans, small = [], text.lower()
    if any(w in small for w in ASSIGN_WORDS):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    for run in CANDIDATE.finditer(text):  # a long run of hex digits lies in one of these
        spans += [("hex", run.start() + m.start(), run.start() + m.end())
                  for m in HEX.finditer(run[0]) if len(m[0]) >= LEAST["hex"]]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _outside(start: int, end: int, taken: list[tuple[int, int]]):
    """(start, end) of what ``taken``, in order and apart, leaves of a stretch."""
    for at in range(bisect.bisect_right(taken, start, key=lambda t: t[1]), len(taken)):
        s, e = taken[at]
        if s >= end:
            break
        if s > start:
            yield start, s
        start = max(start, e)
    if start < end:
        yield start, end


def apart(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as stretches in order that don't touch."""
    merged: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def outermost(ranges: list[tuple[int, int]]) -> list[int]:
    """Positions of the ranges that lie in no other one, of ranges that are nested or apart."""
    kept, reach = [], -1
    for i in sorted(range(len(ranges)), key=lambda i: (ranges[i][0], -ranges[i][1])):
        if ranges[i][1] > reach:
            kept.append(i)
            reach = ranges[i][1]
    return kept


def candidates(text: str, spans) -> list[tuple[int, int, str]]:
    """Long runs of base-64 signs, and their long segments.

    A run is what the spans found already leave, cut at ``=``. A run with
    signs that part words (``/``, ``-``, ``_``) is there as a whole, cut at
    ``/``, and cut at all three, each different piece once.
    """
    taken = apart([(start, end) for _, start, end in spans])
    found = []
    for run in CANDIDATE.finditer(text):
        for start, end in _outside(run.start(), run.end(), taken):
            ranges = {(start + m.start(), start + m.end()) for cut in CUTS for m in cut.finditer(text[start:end])}
            found += [(a, b, text[a:b]) for a, b in sorted(ranges)]
    return found


def pair_counts(raw: np.ndarray) -> np.ndarray:
    """How often each sign follows each other one in UTF-8 bytes, as a square table."""
    counts = np.zeros((OTHER + 1) ** 2, np.int64)
    for at in range(0, len(raw), 1 << 20):
        code = _CODE[raw[at:at + (1 << 20) + 1]]
        counts += np.bincount(code[:-1] * (OTHER + 1) + code[1:], minlength=len(counts))
    return counts


def without(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text with a space for each of the ranges, which are in order and apart."""
    pieces, at = [], 0
    for start, end in ranges:
        pieces.append(text[at:start])
        at = end
    return " ".join([*pieces, text[at:]]) if ranges else text


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


@functools.cache
def _places(signs: str) -> np.ndarray:
    """Byte -> its place in an alphabet of ENCODINGS."""
    places = np.zeros(256, np.int64)
    places[np.frombuffer(signs.encode(), np.uint8)] = np.arange(len(signs))
    return places


class Battery:
    """Chi-squared, runs and serial tests of a string, against randomness and against the corpus's ordinary text.

    ``pairs`` are the sign-pair counts of the corpus without its secrets and
    whatever looks random. For each encoding they give what the three
    statistics look like in ordinary text of that alphabet.
    """

    def __init__(self, pairs: np.ndarray) -> None:
        self.pairs = pairs.reshape(OTHER + 1, OTHER + 1)[:OTHER, :OTHER] + 0.5
        self.ordinary: dict[str, tuple] = {}
        self.alphabets = [(name, signs, frozenset(signs)) for name, signs in ENCODINGS]

    def encoding(self, token: str) -> tuple[str, str]:
        used = set(token)
        return next((name, signs) for name, signs, held in self.alphabets if used <= held)

    def _ordinary(self, name: str, signs: str) -> tuple:
        if name not in self.ordinary:
            at = _CODE[np.frombuffer(signs.encode(), np.uint8)]
            joint = self.pairs[np.ix_(at, at)]
            joint = joint / joint.sum()
            left, right = joint.sum(1), joint.sum(0)
            ratio = np.log(joint / np.outer(left, right))
            mean = float((joint * ratio).sum())
            spread = math.sqrt(max(1e-12, float((joint * ratio ** 2).sum()) - mean ** 2))
            changes = float((joint * (_KIND_OF_SIGN[at][:, None] != _KIND_OF_SIGN[at][None, :])).sum())
            self.ordinary[name] = (float((left ** 2).sum()), float((left ** 3).sum()), ratio, mean, spread, changes)
        return self.ordinary[name]

    def drawn_evenly(self, token: str) -> bool:
        """Whether the string looks random in its own alphabet; needs no corpus."""
        _, signs = self.encoding(token)
        return self.looks_random(_places(signs)[np.frombuffer(token.encode(), np.uint8)], len(signs))

    def looks_random(self, x: np.ndarray, size: int) -> bool:
        """None of the three tests rejects equal odds for all signs, each independent of the last."""
        n = len(x)
        seen = np.bincount(x, minlength=size)
        chi, dof = float(((seen - n / size) ** 2).sum() * size / n), size - 1
        cube = ((chi / dof) ** (1 / 3) - (1 - 2 / (9 * dof))) / math.sqrt(2 / (9 * dof))
        if _upper(cube) < RANDOM_LEVEL:
            return False
        high = x * 2 >= size
        above, below = int(high.sum()), int(n - high.sum())
        if not above or not below:
            return False
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * above * below / n
        var = max(1e-9, (mean - 1) * (mean - 2) / (n - 1))
        if 2 * _upper(abs(runs - mean) / math.sqrt(var)) < RANDOM_LEVEL:
            return False
        centred = x - x.mean()
        serial = float((centred[1:] * centred[:-1]).sum() / max(1e-9, (centred ** 2).sum()))
        return 2 * _upper(abs(serial + 1 / n) * math.sqrt(n)) >= RANDOM_LEVEL

    def p_value(self, token: str) -> float:
        """Of ordinary text giving such a string; 1 for a string that doesn't look random."""
        name, signs = self.encoding(token)
        x, size, n = _places(signs)[np.frombuffer(token.encode(), np.uint8)], len(signs), len(token)
        if not self.looks_random(x, size):
            return 1.0
        two, three, ratio, mean, spread, changes = self._ordinary(name, signs)
        seen = np.bincount(x, minlength=size)
        chi = size / n * float((seen ** 2).sum()) - n
        var = 2 * n * (n - 1) * (two - two ** 2) + 4 * n * (n - 1) * (n - 2) * (three - two ** 2)
        even = _upper((size * (1 + (n - 1) * two) - n - chi) / max(1e-9, size / n * math.sqrt(max(0.0, var))))
        kind = _KIND_OF_SIGN[_CODE[np.frombuffer(token.encode(), np.uint8)]]
        turns = int((kind[1:] != kind[:-1]).sum())
        often = _upper((turns - 0.5 - (n - 1) * changes) / math.sqrt(max(1e-9, (n - 1) * changes * (1 - changes))))
        unlike = _upper((mean - float(ratio[x[:-1], x[1:]].mean())) * math.sqrt(n - 1) / spread)
        half = -sum(math.log(max(p, 1e-300)) for p in (even, often if turns else 1.0, unlike))
        return min(1.0, math.exp(-half) * (1 + half + half ** 2 / 2))  # Fisher's combination of three

    def grade(self, token: str) -> int:
        """The p-value on the grid, rounded up: 0 for 1, GRID for 0.1 and so on."""
        return min(GRID_END, int(math.floor(-math.log10(max(self.p_value(token), 1e-300)) * GRID)))


def length_bin(n: int) -> int:
    return max(b for b in LENGTH_BINS if b <= n)


def thresholds(histogram: list[tuple[int, int, int]]) -> dict[int, int]:
    """(bin, grade, n) rows -> least grade flagged in each bin (Benjamini-Hochberg in each bin)."""
    least = {}
    for b in {row[0] for row in histogram}:
        steps = sorted(((g, n) for c, g, n in histogram if c == b), reverse=True)
        total, above = sum(n for _, n in steps), 0
        for g, n in steps:
            above += n
            if g > 0 and 10 ** (-g / GRID) * total / above <= FALSE_DISCOVERIES:
                least[b] = g
    return least


SPANS = "array<struct<kind:string,start:int,end:int>>"
SCAN = (f"kind tinyint, {{key}}, base {SPANS}, "
        "tokens array<struct<start:int,end:int,token:string,even:boolean>>, pair int, n bigint")


def _fit(docs: DataFrame, key: str, text: str, label: str) -> tuple[DataFrame, DataFrame, Battery, dict[int, int]]:
    """(rows without candidates, rows with graded candidates, the battery, thresholds) of all documents."""
    kind = docs.schema[key].dataType.simpleString()
    schema = SCAN.format(key=f"{key} {kind}")
    tests = Battery(np.zeros((OTHER + 1) ** 2, np.int64))

    def each(batches, names):
        pairs = np.zeros((OTHER + 1) ** 2, np.int64)
        for batch in batches:
            rows, left = [], []
            for doc, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = base_spans(words)
                tokens = [(*c, tests.drawn_evenly(c[2])) for c in candidates(words, spans)]
                rows.append((0, doc, [dict(zip(("kind", "start", "end"), s)) for s in spans],
                             [dict(zip(("start", "end", "token", "even"), t)) for t in tokens], None, None))
                left.append(without(words, apart([s[1:] for s in spans] + [t[:2] for t in tokens if t[3]])))
            pairs += pair_counts(np.frombuffer("\n".join(left).encode(), np.uint8))
            if rows:
                yield batch_of(names, list(zip(*rows)))
        if len(seen := np.flatnonzero(pairs)):
            none = [None] * len(seen)
            yield batch_of(names, [[1] * len(seen), none, none, none, seen, pairs[seen]])

    found = stored(map_batches(docs, [key, text_or_empty(text)], each, schema), label)
    pairs = np.zeros((OTHER + 1) ** 2, np.int64)
    for row in found.where("kind = 1").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[row["pair"]] = row["n"]
    battery = Battery(pairs)
    rows = found.where("kind = 0").select(key, "base", "tokens")

    @F.pandas_udf("array<int>")
    def grades(tokens):
        return tokens.map(lambda row: [battery.grade(t["token"]) if t["even"] else 0 for t in row])

    graded = stored(rows.where(F.size("tokens") > 0).select(key, "base", "tokens", grades("tokens").alias("grades")),
                    f"{label}-graded")
    width = F.length("z.tokens.token")
    bins = F.lit(LENGTH_BINS[0])
    for b in LENGTH_BINS[1:]:
        bins = F.when(width >= b, b).otherwise(bins)
    histogram = (graded.select(F.explode(F.arrays_zip("tokens", "grades")).alias("z"))
                 .groupBy(bins.alias("b"), F.col("z.grades").alias("g")).agg(F.count(F.lit(1)).alias("n")).collect())
    return (rows.where(F.size("tokens") == 0), graded, battery,
            thresholds([(r["b"], r["g"], r["n"]) for r in histogram]))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its spans, (key, base, extra): arrays of (kind, start, end).

    A null text is empty; repeated rows and null keys are kept. Candidates are
    runs of 20 or more base-64 signs outside the base spans and their segments
    of that length; of flagged ones inside each other the outer one is given. Ordinary text is
    described by the pair counts of all documents, without base spans and
    candidates that look random: secrets, however many, don't count as
    ordinary. A candidate is flagged as ``random`` if no test of the battery rejects randomness and its p-value
    under ordinary text passes the false-discovery control of its length bin,
    taken over all candidates. Pair counts (67 x 67) and the histogram of
    p-values (5 bins x 3,001 steps) are all that reaches the driver.
    """
    plain, graded, _, least = _fit(docs, key, text, "secret-scan")

    @F.pandas_udf(SPANS)
    def chosen(starts, ends, grades):
        out = []
        for row in zip(starts, ends, grades):
            ranges = [(int(s), int(e)) for s, e, g in zip(*row) if g >= least.get(length_bin(e - s), GRID_END + 1)]
            out.append([{"kind": "random", "start": ranges[i][0], "end": ranges[i][1]} for i in outermost(ranges)])
        return pd.Series(out)

    found = graded.select(key, "base", chosen("tokens.start", "tokens.end", "grades").alias("extra"))
    return found.unionByName(plain.select(key, "base", F.array().cast(SPANS).alias("extra")))


def digest(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_assign, n_access, n_hex, n_random, base_sha256, spans) of ``scan``'s rows."""
    place = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    whole = F.concat("base", "extra")
    ordered = F.array_sort(F.transform(whole, lambda s: F.struct(
        s["start"].alias("start"), place[s["kind"]].alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))))
    count = lambda kind: F.size(F.filter(whole, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return spans.select(
        key, *[count(kind) for kind in KINDS],
        F.sha2(F.concat_ws(",", F.transform("base", line)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform(ordered, line)).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", text: str = "text", length: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``mark``; ``length`` names a column of code points to renew.

    Statistics are taken over all rows first; then each row is scanned again
    where it lies, so no text is shuffled. Null texts, rows, columns and their
    order stay as they are. Overlapping spans get one mark.
    """
    numbered = docs.select(F.lit(0).alias("__key"), F.col(text).alias("__text"))
    _, _, battery, least = _fit(numbered, "__key", "__text", "redact")

    def clean(words: str) -> str:
        spans = base_spans(words)
        ranges = [(start, end) for _, start, end in spans]
        for start, end, token in candidates(words, spans):
            if battery.grade(token) >= least.get(length_bin(len(token)), GRID_END + 1):
                ranges.append((start, end))
        pieces, at = [], 0
        for start, end in sorted(ranges):
            if start >= at:
                pieces += [words[at:start], mark]
            at = max(at, end)
        return "".join([*pieces, words[at:]]) if ranges else words

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        parts = (texts.slice(at, ROWS_AT_ONCE) for at in range(0, len(texts), ROWS_AT_ONCE))
        return pa.concat_arrays([pa.array([t and clean(t) for t in part.to_pylist()], pa.string()) for part in parts]
                                or [pa.array([], pa.string())])

    marked = docs.withColumn(text, cleaned(F.col(text).cast("string")))
    if length and length in docs.columns:
        kind = docs.schema[length].dataType
        marked = marked.withColumn(length, F.when(F.col(text).isNull(), F.col(length))
                                   .otherwise(F.length(text).cast(kind)))
    return marked.select(*docs.columns)
