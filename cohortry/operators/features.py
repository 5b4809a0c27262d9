"""Feature derivation: row-local expressions and the fixed-order feature pipeline."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry import schemas
from cohortry.functions.scalar import (
    atrophy, cut, dummies, item_count, keyword_flags, polynomial_terms, safe_ratio, saturating_score,
)
from cohortry.operators import encode
from cohortry.operators.aggregate import genetic_features
from cohortry.plans.skew import fan_out_left_join


def temporal_features(
    df: DataFrame,
    age: str = "age",
    onset: str = "age_at_onset",
    frequency: str = "seizure_frequency_per_month",
    duration: str = "epilepsy_duration_years",
    include_lowest: bool = False,
) -> DataFrame:
    """Years since onset, burden, age and onset bands. Each part needs its columns only."""
    have = set(df.columns)
    new: dict[str, Column] = {}
    if {age, onset} <= have:
        years = F.col(age) - F.col(onset)
        new["years_since_onset"] = years
        new["years_since_onset_squared"] = years * years
    if {frequency, duration} <= have:
        new["seizure_burden"] = F.col(frequency) * F.col(duration) * 12
        new["avg_yearly_seizures"] = F.col(frequency) * 12
    if age in have:
        band = cut(age, schemas.AGE_EDGES, schemas.AGE_LABELS, include_lowest)
        new |= dummies(band, schemas.AGE_LABELS, "age")
    if onset in have:
        band = cut(onset, schemas.ONSET_EDGES, schemas.ONSET_LABELS, include_lowest)
        new |= dummies(band, schemas.ONSET_LABELS, "onset")
    return df.withColumns(new)


def bin_column(df: DataFrame, value: str, edges: Sequence[float], labels: Sequence[str], name: str,
               include_lowest: bool = False) -> DataFrame:
    return df.withColumn(name, cut(value, edges, labels, include_lowest))


def one_hot(df: DataFrame, value: str, labels: Sequence[str], prefix: str) -> DataFrame:
    """Boolean column per declared label; the source column is dropped."""
    return df.withColumns(dummies(value, labels, prefix)).drop(value)


def treatment_counts(df: DataFrame, value: str = "previous_treatments", sep: str = ";",
                     empty_as_one: bool = False) -> DataFrame:
    """n_previous_treatments and has_previous_treatment.

    ``empty_as_one``: null stays null and '' counts 1, with a boolean flag;
    otherwise both count 0, with a 0/1 flag.
    """
    n = item_count(value, sep, empty_as_one)
    has = F.coalesce(n > 0, F.lit(False))
    return df.withColumns({
        "n_previous_treatments": n,
        "has_previous_treatment": has if empty_as_one else has.cast("int"),
    })


def treatment_features(df: DataFrame, value: str = "previous_treatments", sep: str = ";",
                       words: Sequence[str] = tuple(schemas.DRUG_WORDS)) -> DataFrame:
    if value not in df.columns:
        return df
    return (
        treatment_counts(df, value, sep)
        .withColumns(keyword_flags(value, words))
        .withColumn("treatment_resistance_score", saturating_score("n_previous_treatments"))
    )


def interactions(df: DataFrame, pairs: Sequence[tuple[str, str]] = tuple(schemas.INTERACTION_PAIRS)) -> DataFrame:
    """Product and ratio of each pair whose two columns exist."""
    new: dict[str, Column] = {}
    for a, b in pairs:
        if a in df.columns and b in df.columns:
            new[f"{a}_x_{b}"] = F.col(a) * F.col(b)
            new[f"{a}_div_{b}"] = safe_ratio(a, b)
    return df.withColumns(new)


def polynomial(df: DataFrame, columns: Sequence[str], degree: int = 2) -> DataFrame:
    """Append the terms of degree 2..d over the columns that exist."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns(polynomial_terms(present, degree)) if present else df


def imaging_features(df: DataFrame, intensity: str = "mean_intensity", volume: str = "hippocampal_volume",
                     white: str = "white_matter_volume") -> DataFrame:
    """Z-score (sample std), volume ratio and atrophy; each only if its columns exist."""
    have = set(df.columns)
    if intensity in have:
        df = encode.zscore(df, [intensity], suffix="_norm")
    new: dict[str, Column] = {}
    if {volume, white} <= have:
        new["hippocampal_to_wm_ratio"] = safe_ratio(volume, white)
    if volume in have:
        new["hippocampal_atrophy"] = atrophy(volume)
    return df.withColumns(new)


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns; booleans do not count."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*numeric_columns(df))


def feature_target(df: DataFrame, target: str, drop: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Feature columns (numeric or boolean, none of ``drop``) and the target."""
    if target not in df.columns:
        raise ValueError(f"target column {target} not found")
    excluded = {target, *drop}
    names = [
        f.name for f in df.schema.fields
        if f.name not in excluded and isinstance(f.dataType, (T.NumericType, T.BooleanType))
    ]
    return df.select(*names, target), names


# ---------------------------------------------------------------------------
# Bounds of the narrow types (strict on both sides).
# ---------------------------------------------------------------------------
NARROW_INTS = [("tinyint", -128, 127), ("smallint", -32768, 32767), ("int", -2147483648, 2147483647)]
FLOAT16_MAX = 65504.0
# ---------------------------------------------------------------------------


def narrow_types(df: DataFrame) -> DataFrame:
    """Cast numeric columns to the narrowest type that holds them; one scan for all bounds."""
    integral = [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)]
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, T.FractionalType)
                and not isinstance(f.dataType, T.DecimalType)]
    if not integral and not floating:
        return df
    bounds = df.agg(
        *[F.min(c).alias(f"min_{c}") for c in integral + floating],
        *[F.max(c).alias(f"max_{c}") for c in integral + floating],
    ).first()
    casts: dict[str, Column] = {}
    for c in integral:
        low, high = bounds[f"min_{c}"], bounds[f"max_{c}"]
        if low is not None:
            fit = next((name for name, lo, hi in NARROW_INTS if low > lo and high < hi), None)
            if fit:
                casts[c] = F.col(c).cast(fit)
    for c in floating:
        low, high = bounds[f"min_{c}"], bounds[f"max_{c}"]
        if low is not None and low > -FLOAT16_MAX and high < FLOAT16_MAX:
            casts[c] = F.col(c).cast("float")
    return df.withColumns(casts)


@dataclass
class FeaturePipeline:
    """temporal -> treatment -> genetic -> imaging -> interactions -> encode -> normalise.

    ``fit`` learns codes and scaling from the rows given (normally the training
    split); ``transform`` applies them to any rows. ``fit_transform`` on all
    rows is the one-table form.
    """

    categorical: Sequence[str] = ("sex", "seizure_type")
    numeric: Sequence[str] = (
        "age", "seizure_frequency_per_month", "epilepsy_duration_years", "years_since_onset",
    )
    pairs: Sequence[tuple[str, str]] = tuple(schemas.INTERACTION_PAIRS)
    treatment_sep: str = ";"
    on: str = "patient_id"
    encoders: list[encode.LabelEncoder] = field(default_factory=list)
    scaler: encode.Scaler | None = None

    def derive(self, clinical: DataFrame, genetic: DataFrame | None = None,
               imaging: DataFrame | None = None) -> DataFrame:
        """The stateless part."""
        df = treatment_features(temporal_features(clinical), sep=self.treatment_sep)
        if genetic is not None:
            df = genetic_features(df, genetic, self.on)
        if imaging is not None:
            df = fan_out_left_join(df, imaging_features(imaging), [self.on])
        return interactions(df, self.pairs)

    def fit(self, clinical: DataFrame, genetic: DataFrame | None = None,
            imaging: DataFrame | None = None) -> FeaturePipeline:
        derived = self.derive(clinical, None, imaging)
        if any(c not in derived.columns for c in [*self.categorical, *self.numeric]):
            derived = self.derive(clinical, genetic, imaging)
        self.encoders = encode.LabelEncoder.fit_all(derived, [c for c in self.categorical if c in derived.columns])
        present = [c for c in self.numeric if c in derived.columns]
        # the genetic join never repeats a row: statistics of columns that do not
        # come from it are the same without it
        self.scaler = encode.Scaler.fit(derived, present, "standard") if present else None
        return self

    def transform(self, clinical: DataFrame, genetic: DataFrame | None = None,
                  imaging: DataFrame | None = None) -> DataFrame:
        df = self.derive(clinical, genetic, imaging)
        for encoder in self.encoders:
            df = encoder.transform(df)
        return self.scaler.transform(df, "_norm") if self.scaler else df

    def fit_transform(self, clinical: DataFrame, genetic: DataFrame | None = None,
                      imaging: DataFrame | None = None) -> DataFrame:
        return self.fit(clinical, genetic, imaging).transform(clinical, genetic, imaging)
