"""Aggregations: per-subject records, reports, statistics and classification metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry import schemas
from cohortry.plans.ordered import exact_quantiles, running_total


def _any(condition: Column) -> Column:
    """1 if the condition holds for any row; nulls count as false."""
    return F.max(F.coalesce(condition, F.lit(False)).cast("int"))


def variant_members(genetic: DataFrame, on: str = "patient_id",
                    attributes: Sequence[str] = ("gene", "variant", "variant_type")) -> DataFrame:
    """(patient, attribute, value, n): the distinct members of every attribute, in long form.

    Complete for patients of any size: the shuffle key holds the value too, so
    one patient with a large share of all rows is spread over many tasks.
    """
    return (
        genetic.select(on, *[F.col(a).cast("string").alias(a) for a in attributes])
        .unpivot([on], list(attributes), "attribute", "value")
        .filter(F.col("value").isNotNull())
        .groupBy(on, "attribute", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def aggregate_variants(genetic: DataFrame, on: str = "patient_id", gene: str = "gene", variant: str = "variant",
                       variant_type: str = "variant_type",
                       reference: Sequence[str] = tuple(schemas.REFERENCE_GENES), lists: bool = False) -> DataFrame:
    """One row per patient: the numbers of distinct genes and variants, and the reference genes among them.

    Members are counted by (patient, attribute, value) first, so a patient of
    any size is spread over many tasks. The row holds what is bounded; the
    members themselves are the rows of :func:`variant_members`. Where a
    patient's members fit in a row, ``lists`` adds them as sorted arrays named
    like their columns, from the same aggregate.
    """
    attributes = (gene, variant, variant_type)
    counted = (
        genetic.select(on, *[F.col(a).cast("string").alias(a) for a in attributes])
        .unpivot([on], list(attributes), "attribute", "value")
        .groupBy(on, "attribute", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    known = F.col("value").isNotNull()
    is_ref = (F.col("attribute") == gene) & F.col("value").isin(list(reference))
    return counted.groupBy(on).agg(
        F.count_if((F.col("attribute") == gene) & known).alias("n_genes_affected"),
        F.count_if((F.col("attribute") == variant) & known).alias("n_variants"),
        _any(is_ref).cast("boolean").alias("has_epilepsy_gene"),
        F.sort_array(F.collect_set(F.when(is_ref, F.col("value")))).alias("epilepsy_genes"),
        *[F.sort_array(F.collect_list(F.when(F.col("attribute") == a, F.col("value")))).alias(a) for a in attributes if lists],
    )


def member_lists(genetic: DataFrame, on: str = "patient_id",
                 attributes: Sequence[str] = ("gene", "variant", "variant_type")) -> DataFrame:
    """Sorted distinct members as one array per attribute; for patients whose members fit in a row."""
    members = variant_members(genetic, on, attributes)
    return members.groupBy(on).agg(*[
        F.sort_array(F.collect_list(F.when(F.col("attribute") == a, F.col("value")))).alias(a) for a in attributes])


def reference_members(df: DataFrame, array: str, reference: Sequence[str], prefix: str) -> DataFrame:
    """Add ``has_{prefix}`` and ``{prefix}_members``: the part of an array in a reference set."""
    wanted = F.array(*[F.lit(r) for r in reference])
    return df.withColumns({
        f"has_{prefix}": F.coalesce(F.arrays_overlap(F.col(array), wanted), F.lit(False)),
        f"{prefix}_members": F.filter(F.col(array), lambda x: x.isin(list(reference))),
    })


def genetic_aggregate(genetic: DataFrame, on: str = "patient_id", gene: str = "gene",
                      variant_type: str = "variant_type", significance: str = "clinvar_significance",
                      reference: Sequence = tuple(schemas.REFERENCE_GENES),
                      types: Sequence[str] = tuple(schemas.COUNTED_VARIANT_TYPES),
                      pathogenic: str = "pathogenic") -> DataFrame:
    """Counts and flags per patient.

    Count distinct runs in two steps inside Spark (by patient and gene, then by
    patient), so a hot patient does not end in one task.
    """
    return genetic.groupBy(on).agg(
        F.count(gene).alias("n_variants"),
        F.count_distinct(gene).alias("n_unique_genes"),
        _any(F.lower(F.col(significance)).contains(pathogenic)).alias("has_pathogenic_variant"),
        _any(F.col(gene).isin(list(reference))).alias("has_epilepsy_gene"),
        *[F.count_if(F.col(variant_type) == t).alias(f"n_{t}") for t in types],
    )


def value_lists(genetic: DataFrame, on: str = "patient_id",
                columns: Sequence[str] = ("variant_type", "clinvar_significance")) -> DataFrame:
    """Full value lists per patient as (value, n) runs: one row per patient and value.

    Repeats are counted, not stored: a list with a billion items of five kinds
    is five rows.
    """
    return variant_members(genetic, on, columns)


def genetic_features(clinical: DataFrame, genetic: DataFrame, on: str = "patient_id", **names) -> DataFrame:
    """LEFT join of the genetic aggregate; patients without variants get 0 everywhere."""
    features = genetic_aggregate(genetic, on, **names)
    added = [c for c in features.columns if c != on]
    overlap = [c for c in added if c in clinical.columns]
    return clinical.drop(*overlap).join(features, on, "left").fillna(0, subset=added)


def pivot_counts(df: DataFrame, on: str, category: str, values: Sequence[str], prefix: str = "n_") -> DataFrame:
    """One count column per declared category value."""
    return df.groupBy(on).agg(*[F.count_if(F.col(category) == v).alias(f"{prefix}{v}") for v in values])


def patient_complete_view(patients: DataFrame, clinical: DataFrame, treatments: DataFrame,
                          variants: DataFrame) -> DataFrame:
    """Patient and clinical columns with distinct treatment and variant counts.

    The children are counted per patient before they are joined, so nothing
    fans out. The result equals the join of all four tables with distinct
    counts, because its group keys are exactly the patient and clinical columns.
    """
    clinical_cols = [
        "seizure_type", "seizure_frequency_per_month", "age_at_onset",
        "epilepsy_duration_years", "treatment_response",
    ]
    profile = clinical.select(F.col("patient_id").alias("id"), *clinical_cols).distinct()
    keys = patients.select("id", "patient_id", "age", "sex", "created_at", "updated_at")
    base = keys.join(profile, "id", "left")  # distinct per patient on both sides: no key is hot

    def counted(child: DataFrame, name: str) -> DataFrame:
        return child.groupBy(F.col("patient_id").alias("id")).agg(F.count_distinct("id").alias(name))

    return (
        base.join(counted(treatments, "total_treatments"), "id", "left")
        .join(counted(variants, "total_genetic_variants"), "id", "left")
        .fillna(0, subset=["total_treatments", "total_genetic_variants"])
    )


def prediction_stats(predictions: DataFrame, as_of: Column, days: int = 30,
                     treatment: str = "predicted_treatment", probability: str = "response_probability",
                     confidence: str = "confidence", created: str = "created_at") -> DataFrame:
    """Per treatment: count and averages of the last ``days`` before the date ``as_of``, most frequent first."""
    first_day = F.date_sub(as_of.cast("date"), days)
    recent = predictions.filter(F.col(created) >= first_day.cast("timestamp_ntz"))
    if "created_date" in predictions.columns:  # the sink's partition column
        recent = recent.filter(F.col("created_date") >= first_day)
    return (
        recent
        .groupBy(treatment)
        .agg(
            F.count(F.lit(1)).alias("total_predictions"),
            F.avg(probability).alias("avg_probability"),
            F.avg(confidence).alias("avg_confidence"),
        )
        .orderBy(F.desc("total_predictions"), treatment)
    )


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(value, n, percentage), most frequent first; nulls do not count as a value.

    The share is of all rows, as a scalar subquery over the small counts.
    """
    grouped = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = grouped.agg(F.sum("n")).scalar()
    out = (
        grouped.filter(F.col("value").isNotNull())
        .withColumn("percentage", F.lit(100.0) * F.col("n") / total)
        .orderBy(F.desc("n"), "value")
    )
    return out.limit(top) if top else out


def _unpivot_aggregates(row: DataFrame, columns: Sequence[str], fields: Mapping[str, str]) -> DataFrame:
    """Turn one wide row of aggregates ``{field}_{i}`` into one row per column."""
    entries = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{p}_{i}").alias(name) for name, p in fields.items()])
        for i, c in enumerate(columns)
    ]
    return row.select(F.inline(F.array(*entries)))


def missing_report(df: DataFrame) -> DataFrame:
    """(column, missing, percentage) of columns with nulls, worst first; one scan."""
    columns = df.columns
    wide = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"m_{i}") for i, c in enumerate(columns)],
        F.count(F.lit(1)).alias("total"),
    ).withColumns({f"p_{i}": F.lit(100.0) * F.col(f"m_{i}") / F.col("total") for i in range(len(columns))})
    long = _unpivot_aggregates(wide, columns, {"missing": "m", "percentage": "p"})
    return long.filter("missing > 0").orderBy(F.desc("percentage"), "column")


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, count, mean, std, min, max) with the sample std; one scan for all columns."""
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        aggs += [
            F.count(v).alias(f"n_{i}"), F.avg(v).alias(f"avg_{i}"), F.stddev_samp(v).alias(f"sd_{i}"),
            F.min(v).alias(f"lo_{i}"), F.max(v).alias(f"hi_{i}"),
        ]
    fields = {"count": "n", "mean": "avg", "std": "sd", "min": "lo", "max": "hi"}
    return _unpivot_aggregates(df.agg(*aggs), columns, fields)


def describe_exact(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, interpolated quartiles, max: one row per column."""
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75]).select(
        "column", F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75")
    )
    return moments(df, columns).join(F.broadcast(quartiles), "column", "left").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def column_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mean, median, std)."""
    return describe_exact(df, columns).select("column", "mean", F.col("p50").alias("median"), "std")


def box_stats(df: DataFrame, column: str) -> DataFrame:
    """Quartiles, 1.5 IQR fences, whiskers inside them and the outlier count."""
    quartiles = exact_quantiles(df, [column], [0.25, 0.5, 0.75]).select(
        F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3")
    )
    fences = quartiles.withColumns({
        "low": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
        "high": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")),
    })
    box = fences.select(F.struct("q1", "median", "q3", "low", "high")).scalar()
    v = F.col(column).cast("double")
    inside = v.between(F.col("box.low"), F.col("box.high"))
    return (
        df.select(v.alias(column), box.alias("box"))
        .agg(
            F.first("box").alias("box"),
            F.min(F.when(inside, v)).alias("whisker_low"),
            F.max(F.when(inside, v)).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers"),
        )
        .select("box.q1", "box.median", "box.q3", "whisker_low", "whisker_high", "n_outliers")
    )


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair, over the rows where both exist; one scan.

    One row per column, as a square matrix.
    """
    aggs, at = [], {}
    for i, a in enumerate(columns):
        for j in range(i, len(columns)):
            at[i, j] = at[j, i] = f"r_{i}_{j}"
            aggs.append(F.corr(F.col(a).cast("double"), F.col(columns[j]).cast("double")).alias(f"r_{i}_{j}"))
    rows = [
        F.struct(F.lit(a).alias("column"), *[F.col(at[i, j]).alias(b) for j, b in enumerate(columns)])
        for i, a in enumerate(columns)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, low, high, n): equal widths from minimum to maximum, last bin closed, empty bins kept."""
    v = F.col(column).cast("double")
    bounds = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    # a single value gets a unit-wide range around it
    bounds = bounds.select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    range_ = bounds.select(F.struct("lo", "hi")).scalar()
    counts = (
        df.filter(v.isNotNull())
        .select(F.least(F.width_bucket(v, range_["lo"], range_["hi"], F.lit(bins)), F.lit(bins)).alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    grid = bounds.select("lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")).select(
        F.col("bin").cast("bigint").alias("bin"),
        (F.col("lo") + width * (F.col("bin") - 1)).alias("low"),
        (F.col("lo") + width * F.col("bin")).alias("high"),
    )
    return grid.join(counts, "bin", "left").fillna(0, subset=["n"])


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(class, weight): n / (k * n_class)."""
    counts = df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    return counts.select("class", (totals["n"] / (totals["k"] * F.col("n"))).alias("weight"))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def profile(df: DataFrame) -> DataFrame:
    """(position, column, type, non_null, rows); one scan."""
    columns = df.columns
    wide = df.agg(
        *[F.count(c).alias(f"n_{i}") for i, c in enumerate(columns)], F.count(F.lit(1)).alias("rows")
    )
    entries = [
        F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.col(f"n_{i}").alias("non_null"), F.col("rows"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return wide.select(F.inline(F.array(*entries)))


def confusion_counts(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def classification_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: accuracy and support-weighted precision, recall and F1 (0 where undefined)."""
    n, zero = F.col("n"), F.lit(0).cast("bigint")
    hit = F.when(F.col("label") == F.col("predicted"), n).otherwise(zero)
    sides = F.array(
        F.struct(F.col("label").alias("class"), hit.alias("hit"), n.alias("support"), zero.alias("claimed")),
        F.struct(F.col("predicted").alias("class"), zero.alias("hit"), zero.alias("support"), n.alias("claimed")),
    )
    per_class = (
        confusion_counts(df, label, predicted)
        .select(F.inline(sides))
        .groupBy("class")
        .agg(F.sum("hit").alias("hit"), F.sum("support").alias("support"), F.sum("claimed").alias("claimed"))
    )

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    scored = per_class.withColumns({"precision": share("hit", "claimed"), "recall": share("hit", "support")})
    p, r = F.col("precision"), F.col("recall")
    scored = scored.withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))

    def weighted(c: str) -> Column:
        return F.sum(F.col(c) * F.col("support")) / F.sum("support")

    return scored.agg(
        (F.sum("hit") / F.sum("support")).alias("accuracy"),
        weighted("precision").alias("precision"),
        weighted("recall").alias("recall"),
        weighted("f1").alias("f1_score"),
    )


def roc_auc_ovr(df: DataFrame, label: str, probabilities: str, classes: Sequence) -> DataFrame:
    """One row ``roc_auc``: one-vs-rest area per class, weighted by support; 0 if a class is absent.

    ``probabilities`` is an array in the order of ``classes``. Equal scores are
    collapsed first; the rank sum of the rest is a running total.
    """
    entries = F.array(*[
        F.struct(
            F.lit(i).alias("class"),
            F.element_at(F.col(probabilities), i + 1).cast("double").alias("score"),
            (F.col(label) == F.lit(c)).cast("bigint").alias("pos"),
        )
        for i, c in enumerate(classes)
    ])
    collapsed = (
        df.select(F.inline(entries))
        .groupBy("class", "score")
        .agg(F.sum("pos").alias("pos"), F.sum(1 - F.col("pos")).alias("neg"))
    )
    ranked = running_total(collapsed, "score", ["neg"], ["class"])
    below = F.col("run_neg") - F.col("neg") + F.col("neg") / 2
    per_class = ranked.groupBy("class").agg(
        F.sum(F.col("pos") * below).alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n")
    )
    area = F.try_divide(F.col("wins"), F.col("p").cast("double") * F.col("n").cast("double"))
    total = per_class.agg(
        F.sum(F.coalesce(area, F.lit(0.0)) * F.col("p")).alias("weighted"),
        F.sum("p").alias("support"),
        F.min((F.col("p") > 0) & (F.col("n") > 0)).alias("defined"),
    )
    return total.select(
        F.when(F.col("defined"), F.col("weighted") / F.col("support")).otherwise(F.lit(0.0)).alias("roc_auc")
    )


def evaluate(df: DataFrame, label: str, predicted: str, probabilities: str | None = None,
             classes: Sequence | None = None) -> DataFrame:
    """The five metrics in one row; roc_auc is 0 without probabilities."""
    metrics = classification_metrics(df, label, predicted)
    if probabilities is None:
        return metrics.withColumn("roc_auc", F.lit(0.0))
    return metrics.withColumn("roc_auc", roc_auc_ovr(df, label, probabilities, classes).scalar())


def top_k(df: DataFrame, score: str, k: int, tie: Sequence[str]) -> DataFrame:
    """k highest scores; ties by the given columns."""
    return df.orderBy(F.desc(score), *tie).limit(k)


def top_k_per_group(df: DataFrame, group: Sequence[str], score: str, k: int, tie: Sequence[str],
                    descending: bool = True) -> DataFrame:
    """k best rows per group with their ``rank``; each task keeps k rows per group before the shuffle."""
    order = F.desc(score) if descending else F.asc(score)
    best = Window.partitionBy(*group).orderBy(order, *tie)
    return df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
