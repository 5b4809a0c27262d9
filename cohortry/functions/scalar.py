"""Scalar column expressions; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortry.schemas import ENTROPY_EPSILON, NORMAL_VOLUME, RATIO_EPSILON


def col(c: str | Column) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def cut(value: str | Column, edges: Sequence[float], labels: Sequence[str], include_lowest: bool = False) -> Column:
    """Label of the right-closed interval (edge, next edge]; null outside."""
    v = col(value)
    out = None
    for i, label in enumerate(labels):
        lower = v >= edges[i] if include_lowest and i == 0 else v > edges[i]
        hit = lower & (v <= edges[i + 1])
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out


def dummies(value: str | Column, labels: Sequence[str], prefix: str) -> dict[str, Column]:
    """One boolean column per declared label, also for labels never seen."""
    return {f"{prefix}_{label}": F.coalesce(col(value) == F.lit(label), F.lit(False)) for label in labels}


def safe_ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """a / (b + epsilon); null instead of an error if the sum is exactly 0."""
    return F.try_divide(
        col(numerator).cast("double"), col(denominator).cast("double") + F.lit(RATIO_EPSILON)
    )


def item_count(value: str | Column, sep: str = ";", empty_as_one: bool = False) -> Column:
    """Items of a separated list. Null and '' count 0, or null and 1 if ``empty_as_one``."""
    v = col(value)
    items = F.size(F.split(v, _literal_pattern(sep), -1))
    if empty_as_one:
        return F.when(v.isNotNull(), items)
    return F.when(F.coalesce(v, F.lit("")) == "", F.lit(0)).otherwise(items)


def _literal_pattern(text: str) -> str:
    return "\\Q" + text + "\\E"


def keyword_flags(value: str | Column, words: Sequence[str], prefix: str = "prev") -> dict[str, Column]:
    """0/1 per word: the lower-cased text contains it anywhere."""
    lowered = F.lower(col(value))
    return {
        f"{prefix}_{w}": F.when(lowered.contains(F.lit(w)), F.lit(1)).otherwise(F.lit(0)) for w in words
    }


def saturating_score(count: str | Column, full: float = 5.0) -> Column:
    return F.least(col(count) / F.lit(float(full)), F.lit(1.0))


def atrophy(volume: str | Column, normal: float = NORMAL_VOLUME) -> Column:
    v = col(volume).cast("double")
    share = (F.lit(normal) - v) / F.lit(normal)
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), share))


def content_hash(*columns: str | Column) -> Column:
    """MD5 of one text column, or of several as a JSON object."""
    if len(columns) == 1:
        return F.md5(col(columns[0]).cast("string"))
    return F.md5(F.to_json(F.struct(*[col(c) for c in columns])))


def map_hash(value: str | Column) -> Column:
    """MD5 of a map that does not depend on the order of its entries."""
    entries = F.array_sort(F.map_entries(col(value)))
    return F.md5(F.to_json(F.map_from_entries(entries)))


def fixed2(value: Column) -> Column:
    """Text with two decimals, rounded from the exact binary value, ties to even.

    ``format_string`` rounds the shortest decimal text instead, so 1.005 (which
    is stored just below) would become 1.01. Here the fraction is scaled by a
    power of two that reaches its last bit, so the rest is exact whole-number
    arithmetic. (A fraction below 2**-8 loses bits, but rounds to 0 anyway.)
    """
    size = F.abs(value)
    fraction = size - F.floor(size)

    def cents(bits: int) -> Column:
        scaled = (fraction * F.lit(float(1 << bits))).cast("bigint") * F.lit(100).cast("bigint")
        whole = F.shiftright(scaled, bits)
        rest = scaled.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
        half = F.lit(1 << (bits - 1)).cast("bigint")
        up = (rest > half) | ((rest == half) & (whole % 2 == 1))
        return whole + F.when(up, 1).otherwise(0)

    total = F.floor(size) * 100 + F.when(fraction < 0.0625, cents(60)).otherwise(cents(56))
    text = F.concat(
        F.when(value < 0, F.lit("-")).otherwise(F.lit("")),
        F.floor(total / 100).cast("string"),
        F.lit("."),
        F.lpad((total % 100).cast("string"), 2, "0"),
    )
    return F.when(size < 1e13, text).when(size >= 1e13, F.format_string("%.2f", value))


def duration_text(seconds: str | Column) -> Column:
    s = col(seconds).cast("double")
    amount = F.when(s < 60, s).when(s < 3600, s / 60).otherwise(s / 3600)
    unit = F.when(s < 60, F.lit("s")).when(s < 3600, F.lit("m")).otherwise(F.lit("h"))
    return F.concat(fixed2(amount), unit)


def stamp_text(ts: str | Column) -> Column:
    return F.date_format(col(ts), "yyyyMMdd_HHmmss")


def iso_text(ts: str | Column) -> Column:
    """ISO 8601 text; the fraction appears only if it is not zero."""
    whole = F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(col(ts), "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))


def json_value(*columns: str | Column) -> Column:
    return F.to_json(F.struct(*[col(c) for c in columns]), {"ignoreNullFields": "false"})


def padded_features(values: Sequence[str | Column], zeros: int = 20) -> Column:
    head = F.array(*[col(v).cast("double") for v in values])
    return F.concat(head, F.array_repeat(F.lit(0.0), zeros))


def entropy_confidence(probabilities: str | Column) -> Column:
    """1 - H(p) / ln(k): about 0 for uniform, about 1 for one-hot."""
    p = col(probabilities)
    total = F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x * F.ln(x + F.lit(ENTROPY_EPSILON)))
    return F.lit(1.0) + total / F.ln(F.size(p).cast("double"))


def ranked_classes(probabilities: str | Column) -> Column:
    """Array of (class, probability), most probable first, ties by lowest class."""
    pairs = F.transform(
        col(probabilities),
        lambda x, i: F.struct((-x).alias("negative"), i.cast("int").alias("class"), x.alias("probability")),
    )
    return F.transform(
        F.array_sort(pairs), lambda s: F.struct(s["class"].alias("class"), s["probability"].alias("probability"))
    )


def argmax_class(probabilities: str | Column) -> Column:
    """First index of the largest value, from 0."""
    p = col(probabilities)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def label_of(class_id: str | Column, labels: Mapping[int, str]) -> Column:
    table = F.create_map(*[F.lit(x) for item in sorted(labels.items()) for x in item])
    return F.try_element_at(table, col(class_id).cast("int"))


def rank_alternatives(probabilities: str | Column, labels: Mapping[int, str], n: int = 2) -> dict[str, Column]:
    ranked = ranked_classes(probabilities)
    return {
        "predicted_treatment": label_of(F.element_at(ranked, 1)["class"], labels),
        "response_probability": F.element_at(ranked, 1)["probability"],
        "alternative_treatments": F.transform(
            F.slice(ranked, 2, n),
            lambda s: F.struct(
                label_of(s["class"], labels).alias("treatment"), s["probability"].alias("probability")
            ),
        ),
    }


def polynomial_terms(columns: Sequence[str], degree: int = 2) -> dict[str, Column]:
    """Products of degree 2..d, named 'a^2', 'a b', ... in lexicographic order."""
    from itertools import combinations_with_replacement

    terms: dict[str, Column] = {}
    for d in range(2, degree + 1):
        for combo in combinations_with_replacement(columns, d):
            product = None
            for c in combo:
                product = F.col(c) if product is None else product * F.col(c)
            counted = [(c, combo.count(c)) for c in dict.fromkeys(combo)]
            terms[" ".join(c if n == 1 else f"{c}^{n}" for c, n in counted)] = product
    return terms
