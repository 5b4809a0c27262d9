"""Encoders and scalers: fit to a small state, then transform row by row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.plans.ordered import dense_index

SMALL_DOMAIN = 10_000
NULL_TEXT = "nan"  # a missing value is encoded as this text


@dataclass(frozen=True)
class LabelEncoder:
    """Codes 0..k-1 in sorted value order.

    A domain of up to SMALL_DOMAIN values (checked when fitting) is kept as a
    small local table and broadcast; a larger one is numbered in parallel and
    joined by shuffle.
    """

    column: str
    mapping: DataFrame  # (value, code)
    small: bool

    @classmethod
    def fit(cls, df: DataFrame, column: str) -> LabelEncoder:
        return cls.fit_all(df, [column])[0]

    @classmethod
    def fit_all(cls, df: DataFrame, columns: Sequence[str]) -> list[LabelEncoder]:
        """One encoder per column, from one pass over the rows."""
        if not columns:
            return []
        texts = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(NULL_TEXT)).alias(c) for c in columns])
        values = texts.unpivot([], list(columns), "column", "value").distinct()
        found = values.limit(SMALL_DOMAIN + 1).collect()
        if len(found) <= SMALL_DOMAIN:
            return [cls(c, _codes(df, [r["value"] for r in found if r["column"] == c]), True) for c in columns]
        out = []
        for c in columns:
            mine = values.filter(F.col("column") == c).select("value")
            few = [r["value"] for r in mine.limit(SMALL_DOMAIN + 1).collect()]
            small = len(few) <= SMALL_DOMAIN
            out.append(cls(c, _codes(df, few) if small else dense_index(mine, "value", "code"), small))
        return out

    def transform(self, df: DataFrame, handle_unseen: str = "error") -> DataFrame:
        """Add ``{column}_encoded``; an unseen value is an error, or null with 'keep'."""
        name = f"{self.column}_encoded"
        mapping = self.mapping.select(F.col("value").alias("__v"), F.col("code").alias(name))
        if self.small:
            mapping = F.broadcast(mapping)
        key = F.coalesce(F.col(self.column).cast("string"), F.lit(NULL_TEXT))
        joined = df.join(mapping, key == F.col("__v"), "left").drop("__v")
        if handle_unseen == "keep":
            return joined
        if handle_unseen != "error":
            raise ValueError(f"handle_unseen must be 'error' or 'keep', not {handle_unseen}")
        message = F.concat(F.lit(f"{self.column}: unseen value "), key)
        checked = F.when(F.col(name).isNull(), F.raise_error(message).cast("bigint")).otherwise(F.col(name))
        return joined.withColumn(name, checked)


def _codes(df: DataFrame, values: Sequence[str]) -> DataFrame:
    rows = [(value, code) for code, value in enumerate(sorted(values))]
    return df.sparkSession.createDataFrame(rows, "value string, code bigint")


def label_encode(df: DataFrame, *columns: str) -> DataFrame:
    out = df
    for encoder in LabelEncoder.fit_all(df, columns):
        out = encoder.transform(out)
    return out


@dataclass(frozen=True)
class Scaler:
    """(value - center) / scale per column, from one aggregate over all columns."""

    stats: dict[str, tuple[float | None, float | None]]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], method: str = "standard") -> Scaler:
        pairs = {
            "standard": lambda c: (F.avg(c), F.stddev_pop(c)),
            "zscore": lambda c: (F.avg(c), F.stddev_samp(c)),
            "minmax": lambda c: (F.min(c).cast("double"), (F.max(c) - F.min(c)).cast("double")),
        }
        if method not in pairs:
            raise ValueError(f"method {method} is not supported")
        aggs = []
        for i, c in enumerate(columns):
            center, scale = pairs[method](c)
            aggs += [center.alias(f"c{i}"), scale.alias(f"s{i}")]
        row = df.agg(*aggs).first()
        stats = {c: (row[f"c{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}
        if method == "zscore":  # undefined for a constant column
            stats = {c: (center, scale or None) for c, (center, scale) in stats.items()}
        return cls(stats)

    def expression(self, column: str) -> Column:
        center, scale = self.stats[column]
        if center is None or scale is None:
            return F.lit(None).cast("double")
        # scale 0: a constant column becomes 0
        return (F.col(column) - F.lit(center)) / F.lit(scale if scale else 1.0)

    def transform(self, df: DataFrame, suffix: str) -> DataFrame:
        return df.withColumns({f"{c}{suffix}": self.expression(c) for c in self.stats})


def standard_scale(df: DataFrame, columns: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """Population standard deviation; constant columns become 0."""
    return Scaler.fit(df, columns, "standard").transform(df, suffix)


def zscore(df: DataFrame, columns: Sequence[str], suffix: str = "_norm") -> DataFrame:
    """Sample standard deviation; null for a constant column."""
    return Scaler.fit(df, columns, "zscore").transform(df, suffix)


def minmax_scale(df: DataFrame, columns: Sequence[str], suffix: str = "_norm") -> DataFrame:
    return Scaler.fit(df, columns, "minmax").transform(df, suffix)


def normalize(df: DataFrame, columns: Sequence[str], method: str = "standard") -> DataFrame:
    """Standard or min-max scaling of the columns that exist, as ``{column}_norm``."""
    if method not in ("standard", "minmax"):
        raise ValueError(f"method {method} is not supported")
    present = [c for c in columns if c in df.columns]
    return Scaler.fit(df, present, method).transform(df, "_norm") if present else df


@dataclass(frozen=True)
class Projection:
    """Centred principal components."""

    columns: Sequence[str]
    means: dict[str, float]
    components: list[list[float]]  # one list of loadings per component
    explained: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for i, loadings in enumerate(self.components):
            terms = [
                (F.col(c).cast("double") - F.lit(self.means[c])) * F.lit(w)
                for c, w in zip(self.columns, loadings)
            ]
            total = terms[0]
            for term in terms[1:]:
                total = total + term
            new[f"pca_{i}"] = total
        return df.withColumns(new)


def fit_pca(df: DataFrame, columns: Sequence[str], k: int) -> Projection:
    """Loadings from the distributed covariance; only a (columns x columns) matrix is local.

    Sign: the loading of largest magnitude is positive.
    """
    row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    means = {c: row[c] for c in columns}
    centred = df.select(*[(F.col(c).cast("double") - F.lit(means[c])).alias(c) for c in columns])
    vectors = VectorAssembler(inputCols=list(columns), outputCol="v", handleInvalid="skip").transform(centred)
    model = PCA(k=k, inputCol="v", outputCol="p").fit(vectors)
    matrix = model.pc.toArray()
    components = []
    for i in range(k):
        loadings = [float(x) for x in matrix[:, i]]
        sign = 1.0 if max(loadings, key=abs) > 0 else -1.0
        components.append([sign * x for x in loadings])
    return Projection(list(columns), means, components, [float(x) for x in model.explainedVariance])


def pca(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """Append ``pca_0``.. over the numeric columns."""
    from cohortry.operators.features import numeric_columns

    return fit_pca(df, list(columns) if columns else numeric_columns(df), k).transform(df)
