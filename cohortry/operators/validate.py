"""Validation: row rules, failure reports, constraints and de-duplication."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry import schemas
from cohortry.functions.scalar import col
from cohortry.plans.skew import flag_repeated

FAILURE = "array<struct<column:string,check:string,value:string>>"


@dataclass(frozen=True)
class Rule:
    """A check on one column; ``fails`` gets the typed column."""

    column: str
    check: str
    fails: Callable[[Column], Column]


def between(column: str, low: float | None = None, high: float | None = None) -> list[Rule]:
    rules = []
    if low is not None:
        rules.append(Rule(column, f"greater_than_or_equal_to({low})", lambda c: c < low))
    if high is not None:
        rules.append(Rule(column, f"less_than_or_equal_to({high})", lambda c: c > high))
    return rules


def isin(column: str, values: Sequence[str]) -> list[Rule]:
    return [Rule(column, "isin", lambda c: ~c.isin(list(values)))]


def not_null(*columns: str) -> list[Rule]:
    return [Rule(c, "not_nullable", lambda c: c.isNull()) for c in columns]


@dataclass(frozen=True)
class RuleSet:
    """Declared columns, row rules, unique columns; ``strict`` forbids extra columns."""

    schema: T.StructType
    rules: Sequence[Rule] = ()
    unique: Sequence[str] = ()
    strict: bool = False
    coerce: bool = True


CLINICAL_RULES = RuleSet(
    schema=schemas.CLINICAL,
    rules=[
        *not_null(*schemas.CLINICAL.fieldNames()),
        *between("age", 0, 120),
        *isin("sex", schemas.SEXES),
        *isin("seizure_type", schemas.SEIZURE_TYPES),
        *between("seizure_frequency_per_month", 0),
        *between("age_at_onset", 0, 120),
        *between("epilepsy_duration_years", 0),
        *isin("treatment_response", schemas.RESPONSES),
    ],
    unique=["patient_id"],
    strict=True,
)

GENETIC_RULES = RuleSet(
    schema=schemas.GENETIC,
    rules=[
        *not_null("patient_id", "gene", "variant", "variant_type"),
        *isin("variant_type", schemas.VARIANT_TYPES),
        *between("allele_frequency", 0, 1),
    ],
)


def _typed(df: DataFrame, declared: T.StructField) -> Column:
    """The column in its declared type; null where the value does not fit.

    Text such as '30.0' is a whole number, '30.5' is not.
    """
    value = F.col(declared.name)
    cast = value.try_cast(declared.dataType)
    from_text = isinstance(df.schema[declared.name].dataType, T.StringType)
    if from_text and isinstance(declared.dataType, T.IntegralType):
        number = value.try_cast("double")
        return F.coalesce(cast, F.when(number == F.floor(number), number.try_cast(declared.dataType)))
    return cast


def coerce(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast declared columns; values that do not fit become null."""
    return df.withColumns({f.name: _typed(df, f) for f in schema.fields if f.name in df.columns})


def check_columns(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Failures of the column set itself; they never remove rows."""
    return df.sparkSession.createDataFrame(column_failures(df.columns, rules), "column string, check string")


def column_failures(columns: Sequence[str], rules: RuleSet) -> list[tuple[str, str]]:
    """(column, check) for declared columns that are absent and, if strict, for others that are there."""
    declared = rules.schema.fieldNames()
    failures = [(c, "column_in_dataframe") for c in declared if c not in columns]
    return failures + [(c, "column_in_schema") for c in columns if rules.strict and c not in declared]


def with_failures(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Typed rows plus ``failures``: every failed check of the row, not only the first.

    One projection for all row rules; only the unique rules need a shuffle.
    """
    present = {f.name: f for f in rules.schema.fields if f.name in df.columns}
    for i, key in enumerate(rules.unique):
        if key in present:
            df = flag_repeated(df, [key], f"__dup{i}")

    def failure(condition: Column, column: str, check: str) -> Column:
        entry = F.struct(
            F.lit(column).alias("column"), F.lit(check).alias("check"), F.col(column).cast("string").alias("value")
        )
        return F.when(condition, entry)

    found = []
    for name, declared in present.items():
        if rules.coerce:
            bad = F.col(name).isNotNull() & _typed(df, declared).isNull()
            found.append(failure(bad, name, f"coerce_dtype({declared.dataType.simpleString()})"))
    for rule in rules.rules:
        if rule.column in present:
            typed = _typed(df, present[rule.column])
            bad = rule.fails(typed)
            if rule.check == "not_nullable":
                bad = F.col(rule.column).isNull()
            found.append(failure(bad, rule.column, rule.check))
    for i, key in enumerate(rules.unique):
        if key in present:
            found.append(failure(F.col(f"__dup{i}"), key, "field_uniqueness"))

    failures = F.array_compact(F.array(*found)) if found else F.array()
    checked = df.withColumn("failures", failures.cast(FAILURE))
    checked = checked.drop(*[f"__dup{i}" for i in range(len(rules.unique))])
    return coerce(checked, rules.schema) if rules.coerce else checked


def failure_report(df: DataFrame, rules: RuleSet, row_key: str) -> DataFrame:
    """Long table of all failures: (row_key, column, check, value).

    Failures of the column set come too, once each, with a null row key.
    """
    key = F.col(row_key) if row_key in df.columns else F.lit(None).cast("string")
    rows = (
        with_failures(df, rules)
        .select(key.alias("row_key"), F.explode("failures").alias("f"))
        .select("row_key", "f.column", "f.check", "f.value")
    )
    return rows.unionByName(check_columns(df, rules), allowMissingColumns=True)


def split_valid(df: DataFrame, rules: RuleSet) -> tuple[DataFrame, DataFrame]:
    """(typed rows without failures, failed rows with their failures).

    Failures of the column set are in :func:`failure_report`; they remove no row.
    """
    checked = with_failures(df, rules)
    ok = F.size("failures") == 0
    return checked.filter(ok).drop("failures"), checked.filter(~ok)


def flag_duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Add ``is_duplicate``: true for every copy of a repeated key."""
    return flag_repeated(df, keys, "is_duplicate")


def dedup_first(df: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """First row per key. Spark keeps one row per key and task before the shuffle."""
    first = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(first)).filter(F.col("__rn") == 1).drop("__rn")


# ---------------------------------------------------------------------------
# Messages of the patient record check.
# ---------------------------------------------------------------------------
REQUIRED_FIELDS = [
    "patient_id", "age", "sex", "seizure_type",
    "seizure_frequency_per_month", "age_at_onset", "epilepsy_duration_years",
]
MISSING_FIELD = "Campo obrigatório ausente: "
BAD_AGE = "Idade inválida (deve estar entre 0 e 120)"
BAD_SEX = "Sexo inválido (deve ser M, F ou Other)"
BAD_FREQUENCY = "Frequência de crises inválida (deve ser >= 0)"
BAD_ONSET = "Idade de início não pode ser maior que idade atual"
# ---------------------------------------------------------------------------


def validate_records(
    df: DataFrame,
    age: str = "age",
    onset: str = "age_at_onset",
    frequency: str = "seizure_frequency_per_month",
    sex: str = "sex",
    sexes: Sequence[str] = tuple(schemas.SEXES),
    required: Sequence[str] = tuple(REQUIRED_FIELDS),
    age_range: tuple[float, float] = (0, 120),
) -> DataFrame:
    """Add ``errors`` (array of messages) and ``is_valid``. A null field counts as absent."""
    checks: list[Column] = []
    for name in required:
        missing = F.col(name).isNull() if name in df.columns else F.lit(True)
        checks.append(F.when(missing, F.lit(MISSING_FIELD + name)))
    have = set(df.columns)
    if age in have:
        checks.append(F.when((F.col(age) < age_range[0]) | (F.col(age) > age_range[1]), F.lit(BAD_AGE)))
    if sex in have:
        checks.append(F.when(~F.col(sex).isin(list(sexes)), F.lit(BAD_SEX)))
    if frequency in have:
        checks.append(F.when(F.col(frequency) < 0, F.lit(BAD_FREQUENCY)))
    if onset in have and age in have:
        checks.append(F.when(F.col(onset) > F.col(age), F.lit(BAD_ONSET)))
    out = df.withColumn("errors", F.array_compact(F.array(*checks)).cast("array<string>"))
    return out.withColumn("is_valid", F.size("errors") == 0)


def validate_nested(
    df: DataFrame,
    array: str = "genetic_variants",
    member: str = "variant_type",
    allowed: Sequence[str] = tuple(schemas.VARIANT_TYPES),
    scalar: str | None = "seizure_type",
    scalar_allowed: Sequence[str] = tuple(schemas.SEIZURE_TYPES),
) -> DataFrame:
    """Add ``is_valid``: every array member and the scalar lie in their sets."""
    members = F.forall(array, lambda x: F.coalesce(x[member].isin(list(allowed)), F.lit(False)))
    ok = F.coalesce(members, F.lit(True))
    if scalar is not None:
        ok = ok & F.coalesce(F.col(scalar).isin(list(scalar_allowed)), F.lit(False))
    return df.withColumn("is_valid", ok)


@dataclass
class Processed:
    """Result of a modality; the counts are ready once ``data`` has been used."""

    data: DataFrame
    errors: DataFrame
    n_input: Observation
    n_output: Observation
    metadata: Mapping[str, str] = field(default_factory=dict)
    started: float = field(default_factory=time.monotonic)

    def processing_time(self) -> float:
        """Seconds from the definition of the job to its counts; waits for them."""
        _ = self.n_output.get
        return time.monotonic() - self.started

    def summary(self) -> dict[str, int]:
        return {
            "n_records_input": self.n_input.get["n"],
            "n_records_output": self.n_output.get["n"],
            "n_failed": self.n_input.get["n"] - self.n_input.get["n_ok"],
        }


def process(df: DataFrame, rules: RuleSet, transform: Callable[[DataFrame], DataFrame] | None = None,
            name: str = "", row_key: str | None = None) -> Processed:
    """Validate and transform; rows are counted while they pass, without a scan of their own.

    Absent and unwanted columns are reported in ``errors`` and remove no row;
    unwanted ones are not passed on. Where a column that must not be null is
    absent the transform can't run: the valid rows come out as they are.
    """
    faults = column_failures(df.columns, rules)
    before, after = Observation(), Observation()
    ok = F.size("failures") == 0
    checked = with_failures(df, rules)
    seen = checked.observe(
        before, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(ok.cast("long")), F.lit(0)).alias("n_ok")
    )
    unwanted = [c for c, check in faults if check == "column_in_schema"]
    valid = seen.filter(ok).drop("failures", *unwanted)
    absent = [c for c, check in faults if check == "column_in_dataframe"]
    needed = {r.column for r in rules.rules if r.check == "not_nullable"}
    out = transform(valid) if transform and not needed & set(absent) else valid
    out = out.observe(after, F.count(F.lit(1)).alias("n"))
    return Processed(
        data=out,
        errors=failure_report(df, rules, row_key or rules.schema.fieldNames()[0]),
        n_input=before,
        n_output=after,
        metadata={"processor": name, "absent": ",".join(absent), "unwanted": ",".join(unwanted)},
    )


def count_violations(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """(constraint, violations) for CHECK and NOT NULL style conditions, one scan.

    A check is violated where it is false; null passes, as in SQL.
    """
    names = list(checks)
    counted = df.agg(
        *[F.count_if(F.coalesce(~checks[n], F.lit(False))).alias(f"c{i}") for i, n in enumerate(names)]
    )
    entries = [F.struct(F.lit(n).alias("constraint"), F.col(f"c{i}").alias("violations")) for i, n in enumerate(names)]
    return counted.select(F.inline(F.array(*entries)))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose (non-null) key has no parent."""
    parents = parent.select(F.col(parent_key).alias(child_key))
    return child.filter(F.col(child_key).isNotNull()).join(parents, child_key, "left_anti")


def warehouse_constraints(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Violations of the declared constraints of the warehouse tables given."""
    parts: list[DataFrame] = []
    patients = tables.get("patients")
    if patients is not None:
        parts.append(count_violations(patients, {
            "patients.age_range": col("age").between(0, 120),
            "patients.patient_id_not_null": col("patient_id").isNotNull(),
            "patients.age_not_null": col("age").isNotNull(),
            "patients.sex_not_null": col("sex").isNotNull(),
        }))
        repeated = patients.groupBy("patient_id").count().filter("count > 1 and patient_id is not null")
        parts.append(repeated.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit("patients.patient_id_unique").alias("constraint"), "violations"))
    if "clinical_data" in tables:
        parts.append(count_violations(tables["clinical_data"], {
            "clinical_data.frequency_range": col("seizure_frequency_per_month") >= 0,
            "clinical_data.onset_range": col("age_at_onset") >= 0,
            "clinical_data.duration_range": col("epilepsy_duration_years") >= 0,
            "clinical_data.seizure_type_not_null": col("seizure_type").isNotNull(),
            "clinical_data.frequency_not_null": col("seizure_frequency_per_month").isNotNull(),
            "clinical_data.onset_not_null": col("age_at_onset").isNotNull(),
            "clinical_data.duration_not_null": col("epilepsy_duration_years").isNotNull(),
        }))
    if "predictions" in tables:
        parts.append(count_violations(tables["predictions"], {
            "predictions.probability_range": col("response_probability").between(0, 1),
            "predictions.confidence_range": col("confidence").between(0, 1),
        }))
    if patients is not None:
        for name in ("clinical_data", "treatments", "genetic_variants", "predictions"):
            if name in tables:
                parts.append(
                    orphans(tables[name], patients, "patient_id", "id")
                    .agg(F.count(F.lit(1)).alias("violations"))
                    .select(F.lit(f"{name}.patient_id_fk").alias("constraint"), "violations")
                )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
