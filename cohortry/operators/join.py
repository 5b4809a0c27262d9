"""Joins between modalities and between subjects."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.plans.session import cut_lineage
from cohortry.plans.skew import counted_side, fan_out_left_join, within

PROBE_PAGE = 1_000
CELLS = 4  # of the grid of values in the width of a band


def merge_modalities(base: DataFrame, others: dict[str, DataFrame], on: str = "patient_id",
                     repeated: Sequence[str] = (), null_safe: bool = False) -> DataFrame:
    """LEFT join each modality; a column name already taken gets the modality as suffix.

    Modalities named in ``repeated`` may hold a subject many times; the others
    hold it once, so a plain left join of two unique keys is enough.
    """
    out = base
    for name, other in others.items():
        for c in other.columns:
            if c != on and c in out.columns:
                other = other.withColumnRenamed(c, f"{c}_{name}")
        if null_safe:
            right = other.withColumnRenamed(on, "__on")
            out = out.join(right, F.col(on).eqNullSafe(F.col("__on")), "left").drop("__on")
        elif name in repeated:
            out = fan_out_left_join(out, other, [on])
        else:
            out = out.join(other, on, "left")
    return out


def surrogate(key: str | Column) -> Column:
    """Deterministic surrogate key: the same natural key always gets the same id."""
    return F.sha2((key if isinstance(key, Column) else F.col(key)).cast("string"), 256)


def resolve_keys(child: DataFrame, parent: DataFrame, natural: str, surrogate_col: str,
                 child_key: str | None = None) -> DataFrame:
    """Replace the natural key by the parent's surrogate; rows with an unknown key are left out."""
    child_key = child_key or natural
    lookup = parent.select(F.col(natural).alias("__natural"), F.col(surrogate_col).alias("__surrogate"))
    joined = child.join(lookup, F.col(child_key) == F.col("__natural"), "inner")
    return joined.withColumn(child_key, F.col("__surrogate")).drop("__natural", "__surrogate")


def profile_score(kind: Column, onset: Column, frequency: Column, probe: Column,
                  onset_within: float = 5, frequency_within: float = 2) -> Column:
    """1 for the same type, 0.5 for a close onset, 0.5 for a close frequency.

    ``probe`` is a struct (kind, onset, frequency).
    """

    def points(hit: Column, value: float) -> Column:
        return F.when(hit, F.lit(value)).otherwise(F.lit(0.0))

    same = kind == probe["kind"]
    near = F.abs(onset - probe["onset"]) <= onset_within
    often = F.abs(frequency - probe["frequency"]) <= frequency_within
    return points(same, 1.0) + points(near, 0.5) + points(often, 0.5)


def similar_by_profile(df: DataFrame, patient, k: int = 10, id_col: str = "patient_id", kind: str = "seizure_type",
                       onset: str = "age_at_onset", frequency: str = "seizure_frequency_per_month",
                       onset_within: float = 5, frequency_within: float = 2) -> DataFrame:
    """The k subjects most like ``patient``, each once, by their best matching record.

    The subject's own records are read as values, so scoring the table is one
    projection, a partial aggregate to the best record of each subject, and a
    top-k: no join. A probe with more distinct profiles than one page is met
    condition by condition, on a grid as wide as the conditions are.
    """
    probes = (
        df.filter(F.col(id_col) == F.lit(patient))
        .select(F.col(kind).alias("kind"), F.col(onset).alias("onset"), F.col(frequency).alias("frequency"))
        .distinct()
    )
    others = df.filter(F.col(id_col) != F.lit(patient))
    if not within(probes, PROBE_PAGE):
        return _top(_best_score(_scored_by_conditions(
            others.select(F.col(id_col).alias("similar_patient_id"), F.col(kind).alias("kind"), F.col(onset).alias("onset"),
                          F.col(frequency).alias("frequency")),
            cut_lineage(probes, "probes"), {"onset": onset_within, "frequency": frequency_within})), k)
    rows = probes.collect()
    if not rows:
        return others.limit(0).select(F.col(id_col).alias("similar_patient_id"), F.lit(0.0).alias("similarity_score"))
    structs = [F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in probes.schema.fields]) for r in rows]

    def scored(probe: Column) -> Column:
        return profile_score(F.col(kind), F.col(onset), F.col(frequency), probe, onset_within, frequency_within)

    score = scored(structs[0]) if len(structs) == 1 else F.array_max(F.transform(F.array(*structs), scored))
    return _top(_best_score(others.select(F.col(id_col).alias("similar_patient_id"), score.alias("similarity_score"))), k)


POINTS = {"kind": 1.0, "onset": 0.5, "frequency": 0.5}


def _scored_by_conditions(others: DataFrame, probes: DataFrame, within_of: Mapping[str, float]) -> DataFrame:
    """(similar_patient_id, similarity_score) of each record, or profile of a subject, by its best probe, without pairs of records.

    A score says which conditions hold. For each set of them, greatest score
    first, the profiles that meet some probe in all of them take its score and
    are done; the others go on. A profile meets the probes' distinct values of
    the set's columns only. Sides are broadcast if they are counted to be small.
    """
    names = list(POINTS)
    left = cut_lineage(others.distinct(), "profiles")
    sets = sorted((c for c in product([False, True], repeat=3) if any(c)), key=lambda c: -sum(p for p, x in zip(POINTS.values(), c) if x))
    done = None
    for chosen in sets:
        needed = [n for n, c in zip(names, chosen) if c]
        met = _meeting(left.select(*needed).distinct(), probes.select(*needed).distinct(), needed,
                       {n: within_of[n] for n in needed if n in within_of})
        score = F.lit(sum(POINTS[n] for n in needed))
        flagged = left.join(counted_side(cut_lineage(met.withColumn("__met", F.lit(True)), "met")), needed, "left")
        flagged = cut_lineage(flagged, "profiles")
        part = flagged.filter("__met").select("similar_patient_id", score.alias("similarity_score"))
        done = part if done is None else done.unionByName(part)
        left = flagged.filter("__met IS NULL").drop("__met")
    return done.unionByName(left.select("similar_patient_id", F.lit(0.0).alias("similarity_score")))


def _meeting(values: DataFrame, probes: DataFrame, columns: Sequence[str], bands: Mapping[str, float]) -> DataFrame:
    """The distinct ``values`` that equal some of the distinct ``probes``, or lie within its band for the columns that have one."""
    known, asked = values.dropna(), probes.dropna()
    if not bands:
        return known.join(counted_side(asked), list(columns), "left_semi")
    width = {c: w * 1.001 if w else 1.0 for c, w in bands.items()}
    cell = lambda c: F.floor(F.col(c) / F.lit(width[c]))
    grid = asked.select(*[F.col(c).alias(f"__o_{c}") for c in columns], *[cell(c).alias(f"__d_{c}") for c in bands])
    for c in bands:  # the cells around a probe's own: there are fewer probes than values, mostly
        grid = grid.withColumn(f"__d_{c}", F.explode(F.array(*[F.col(f"__d_{c}") + step for step in (-1, 0, 1)])))
    on = [F.col(c) == F.col(f"__o_{c}") for c in columns if c not in bands]
    on += [cell(c) == F.col(f"__d_{c}") for c in bands]
    on += [F.abs(F.col(f"__o_{c}") - F.col(c)) <= w for c, w in bands.items()]
    return known.join(counted_side(grid), on, "left_semi")


def _best_score(scored: DataFrame) -> DataFrame:
    return scored.groupBy("similar_patient_id").agg(F.max("similarity_score").alias("similarity_score"))


def _top(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("similarity_score"), "similar_patient_id").limit(k)


def similar_to_each(df: DataFrame, k: int = 10, id_col: str = "patient_id", kind: str = "seizure_type",
                    onset: str = "age_at_onset", frequency: str = "seizure_frequency_per_month",
                    onset_within: float = 5, frequency_within: float = 2) -> DataFrame:
    """``similar_by_profile`` for every subject at once: (patient_id, rank, similar_patient_id, similarity_score).

    Exact, without pairs of subjects. Whoever is among the k best of a subject
    meets some of the three conditions, and then is one of the k + 1 smallest ids
    that meet these, as all who meet them score as much. So for each of the eight
    sets of conditions a list of k + 1 ids is made for each profile, and the lists
    are merged row by row. Lists depend on the values only: the subjects of one
    profile are reduced to their k + 1 smallest ids first, cells of a grid that lie
    within a condition are merged as a whole, and of the cells at its rim only ids
    below the last of those leave a join (``_smallest_ids``).

    The distinct records are stored first, as every list reads them. A null or
    NaN value meets no condition; a subject with several records
    counts by the best pair of records; rows with a null id take no part.
    """
    names = ["kind", "onset", "frequency"]
    records = cut_lineage(df.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(kind).alias("kind"), F.col(onset).alias("onset"),
        F.col(frequency).alias("frequency")).distinct(), "records")
    within_of = {"onset": onset_within, "frequency": frequency_within}
    smallest = records.select("id").distinct().orderBy("id").limit(k + 1).agg(F.sort_array(F.collect_list("id")))

    lists = records.select(*names).distinct().withColumn("__l0", smallest.scalar())
    scores = [0.0]
    for chosen in product([False, True], repeat=3):
        needed = [n for n, c in zip(names, chosen) if c]
        if not needed:
            continue
        bands = {n: within_of[n] for n in needed if n in within_of}
        name = f"__l{len(scores)}"
        lists = lists.join(_smallest_ids(records, needed, bands, k + 1).withColumnRenamed("ids", name), needed, "left")
        scores.append(sum(POINTS[n] for n in needed))

    # best score first; an id that an earlier list holds keeps that list's score
    ids, points = F.slice("__l0", 1, 0), F.array().cast("array<double>")
    for score in sorted(set(scores), reverse=True):
        of_score = [F.coalesce(f"__l{i}", F.slice("__l0", 1, 0)) for i, s in enumerate(scores) if s == score]
        lists = lists.withColumns({"__ids": ids, "__points": points})
        more = F.array_except(F.array_sort(F.array_distinct(F.concat(*of_score))), "__ids")
        ids = F.slice(F.concat("__ids", more), 1, k + 1)
        points = F.slice(F.concat("__points", F.array_repeat(F.lit(score), F.size(more))), 1, k + 1)
    of_profile = lists.select(*[F.col(n).alias(f"__{n}") for n in names], F.arrays_zip(
        ids.alias("other"), points.alias("score")).alias("others"))
    same = [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names]
    pairs = records.join(of_profile, same).select("id", F.explode("others").alias("o")).filter(F.col("o.other") != F.col("id"))
    scored = pairs.groupBy(F.col("id").alias("patient_id"), F.col("o.other").alias("similar_patient_id")).agg(
        F.max("o.score").alias("similarity_score"))
    rank = F.row_number().over(Window.partitionBy("patient_id").orderBy(F.desc("similarity_score"), "similar_patient_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        "patient_id", "rank", "similar_patient_id", "similarity_score")


def _smallest_ids(records: DataFrame, columns: Sequence[str], bands: Mapping[str, float], n: int) -> DataFrame:
    """(columns, ids): for each occurring value of ``columns`` the n smallest ids of records that equal it, or lie
    within its band for the columns that have one.

    Bands are covered by cells, of which CELLS make a band's width. Cells that lie
    within the bands of all values of a cell are merged cell by cell; the cells that a
    band may cut are looked at value by value, but only ids below the n-th of the
    whole cells leave that join, so what is shuffled follows the values, not their pairs.
    """
    known = records.dropna(subset=list(columns)).select("id", *columns)
    for c in bands:  # what is not finite is near nothing
        known = known.filter(F.abs(F.col(c).cast("double")) < F.lit(math.inf))
    if any(w < 0 for w in bands.values()):
        known = known.limit(0)
    values = _first_ids(known, columns, n)
    bands = {c: w for c, w in bands.items() if w > 0}
    if not bands:
        return values
    exact, cells = [c for c in columns if c not in bands], [f"__c_{c}" for c in bands]
    # a little wider than the band in all, so that rounding can't put values within it further apart
    values = cut_lineage(values.select(
        "*", *[F.floor(F.col(c) / F.lit(w * 1.001 / CELLS)).alias(f"__c_{c}") for c, w in bands.items()]), "values")
    homes = [*exact, *cells]
    of_cell = _first_ids(values.select(F.explode("ids").alias("id"), *homes), homes, n)

    # cells that lie within the bands of all values of a cell
    near = F.array(*[F.lit(step).cast("bigint") for step in range(2 - CELLS, CELLS - 1)])
    reach = of_cell.select(*exact, *[F.col(c).alias(f"__h{c}") for c in cells], *cells)
    for c in cells:
        reach = reach.withColumn("__step", F.explode(near)).withColumn(c, F.col(c) + F.col("__step")).drop("__step")
    whole = reach.join(of_cell, homes).select(
        *exact, *[F.col(f"__h{c}").alias(c) for c in cells], F.explode("ids").alias("id"))
    whole = _first_ids(whole, homes, n).withColumnRenamed("ids", "__whole")

    # of the cells that a band may cut, only ids below the n-th of those whole ones can still be among the first
    bound = cut_lineage(values.join(whole, homes), "bounds")
    wide = {c: F.floor(F.col(c) / F.lit(w * 1.001)) for c, w in bands.items()}
    probes = bound.select(*columns, *cells, F.get("__whole", F.lit(n - 1)).alias("__last"),
                          *[cell.alias(f"__w_{c}") for c, cell in wide.items()])
    for c in bands:
        probes = probes.withColumn(f"__w_{c}", F.explode(F.array(*[F.col(f"__w_{c}") + step for step in (-1, 0, 1)])))
    others = values.select(*[F.col(c).alias(f"__o_{c}") for c in columns], *[F.col(c).alias(f"__o{c}") for c in cells],
                           *[cell.alias(f"__v_{c}") for c, cell in wide.items()], F.explode("ids").alias("id"))
    on = [F.col(c) == F.col(f"__o_{c}") for c in exact]
    on += [F.col(f"__w_{c}") == F.col(f"__v_{c}") for c in bands]
    on += [F.abs(F.col(f"__o_{c}") - F.col(c)) <= w for c, w in bands.items()]
    on += [F.col("__last").isNull() | (F.col("id") < F.col("__last"))]
    on += [F.greatest(*[F.abs(F.col(f"__o{c}") - F.col(c)) for c in cells], F.lit(0)) > CELLS - 2]
    cut = _first_ids(probes.join(others, on).select("id", *columns), columns, n).withColumnRenamed("ids", "__cut")
    both = F.concat("__whole", F.coalesce("__cut", F.slice("__whole", 1, 0)))
    return bound.join(cut, list(columns), "left").select(
        *columns, F.slice(F.array_sort(F.array_distinct(both)), 1, n).alias("ids"))


def _first_ids(rows: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """(columns, ids): the n smallest distinct ids of each value of ``columns``, in order."""
    first = F.row_number().over(Window.partitionBy(*columns).orderBy("id"))
    return rows.select("id", *columns).distinct().withColumn("__n", first).filter(F.col("__n") <= n).groupBy(*columns).agg(
        F.sort_array(F.collect_list("id")).alias("ids"))


def endpoints_exist(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi"
    ).select(*edges.columns)


def unseen(new: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` whose key is not in ``existing``."""
    return new.join(existing.select(key), key, "left_anti")
