"""Declared schemas and the fixed values of the clinical domain."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# They decide results, so they are stated as they are.
# ---------------------------------------------------------------------------
SEXES = ["M", "F", "Other"]
SEIZURE_TYPES = [
    "focal_aware",
    "focal_impaired_awareness",
    "focal_to_bilateral_tonic_clonic",
    "generalized_tonic_clonic",
    "absence",
    "myoclonic",
    "atonic",
]
RESPONSES = ["responder", "non_responder", "partial_responder"]
VARIANT_TYPES = ["missense", "nonsense", "frameshift", "splice_site", "synonymous"]
COUNTED_VARIANT_TYPES = ["missense", "nonsense", "frameshift", "splice_site"]
REFERENCE_GENES = [
    "SCN1A", "SCN2A", "SCN8A", "KCNQ2", "KCNQ3",
    "GABRA1", "GABRG2", "STXBP1", "PCDH19", "CDKL5",
]
DRUG_WORDS = [
    "levetiracetam", "lamotrigine", "oxcarbazepine",
    "topiramate", "valproato", "carbamazepina",
]
AGE_EDGES = [0, 12, 18, 30, 50, 120]
AGE_LABELS = ["child", "adolescent", "young_adult", "adult", "senior"]
ONSET_EDGES = [0, 1, 5, 12, 18, 120]
ONSET_LABELS = ["neonatal", "infant", "childhood", "adolescent", "adult_onset"]
INTERACTION_PAIRS = [
    ("age", "seizure_frequency_per_month"),
    ("years_since_onset", "seizure_frequency_per_month"),
    ("n_previous_treatments", "seizure_frequency_per_month"),
    ("age", "n_previous_treatments"),
]
RATIO_EPSILON = 1e-6
ENTROPY_EPSILON = 1e-10
NORMAL_VOLUME = 3500.0
TREATMENT_LABELS = {0: "levetiracetam", 1: "lamotrigine", 2: "oxcarbazepine"}
NODE_TYPES = ["Patient", "Gene", "Variant", "Drug", "Phenotype", "Disease", "Pathway", "Protein"]
EDGE_TYPES = [
    "HAS_VARIANT", "AFFECTS_GENE", "TREATED_WITH", "RESPONDS_TO", "HAS_PHENOTYPE",
    "CAUSES", "TARGETS", "INTERACTS_WITH", "PART_OF_PATHWAY", "ENCODES",
]
FEATURE_NODE_TYPES = ["Patient", "Gene", "Drug", "Variant", "Phenotype"]
ENSEMBLE_WEIGHTS = [0.3, 0.3, 0.2, 0.2]
TEXT_SEPARATORS = ["\n\n", "\n", ". ", " ", ""]
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
# ---------------------------------------------------------------------------


STRING, INT, BIGINT, DOUBLE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
BOOLEAN, DATE, TIMESTAMP = T.BooleanType(), T.DateType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


VARIANT = _struct(gene=STRING, variant=STRING, variant_type=STRING)
NUMBERS = T.MapType(STRING, DOUBLE)
PROPERTIES = T.MapType(STRING, STRING)

CLINICAL = _struct(
    patient_id=STRING, age=INT, sex=STRING, seizure_type=STRING, seizure_frequency_per_month=DOUBLE,
    age_at_onset=INT, epilepsy_duration_years=DOUBLE, previous_treatments=STRING, treatment_response=STRING,
)
GENETIC = _struct(
    patient_id=STRING, gene=STRING, variant=STRING, variant_type=STRING,
    allele_frequency=DOUBLE, clinvar_significance=STRING,
)
VCF = _struct(chrom=STRING, pos=INT, ref=STRING, alt=STRING, qual=DOUBLE, sample_id=STRING)
IMAGING = _struct(
    patient_id=STRING, mean_intensity=DOUBLE, std_intensity=DOUBLE, min_intensity=DOUBLE,
    max_intensity=DOUBLE, volume_cm3=DOUBLE, hippocampal_volume=DOUBLE, white_matter_volume=DOUBLE,
)
NODES = _struct(id=STRING, type=STRING, props=PROPERTIES)
EDGES = _struct(src=STRING, dst=STRING, type=STRING, props=PROPERTIES)
RECORD = _struct(
    patient_id=STRING, age=INT, sex=STRING, seizure_type=STRING, seizure_frequency_per_month=DOUBLE,
    age_at_onset=INT, epilepsy_duration_years=DOUBLE, previous_treatments=T.ArrayType(STRING),
    genetic_variants=T.ArrayType(VARIANT), eeg_features=NUMBERS, mri_features=NUMBERS,
)

WAREHOUSE = {
    "patients": _struct(
        id=STRING, patient_id=STRING, age=INT, sex=STRING, created_at=TIMESTAMP, updated_at=TIMESTAMP,
    ),
    "clinical_data": _struct(
        id=STRING, patient_id=STRING, seizure_type=STRING, seizure_frequency_per_month=T.DecimalType(10, 2),
        age_at_onset=INT, epilepsy_duration_years=T.DecimalType(10, 2), treatment_response=STRING,
        created_at=TIMESTAMP, updated_at=TIMESTAMP,
    ),
    "treatments": _struct(
        id=STRING, patient_id=STRING, treatment_name=STRING, start_date=DATE, end_date=DATE,
        dosage=STRING, response=STRING, notes=STRING, created_at=TIMESTAMP,
    ),
    "genetic_variants": _struct(
        id=STRING, patient_id=STRING, gene=STRING, variant=STRING, variant_type=STRING,
        allele_frequency=T.DecimalType(10, 6), clinvar_significance=STRING, created_at=TIMESTAMP,
    ),
    "predictions": _struct(
        id=STRING, patient_id=STRING, model_version=STRING, predicted_treatment=STRING,
        response_probability=T.DecimalType(18, 4), confidence=T.DecimalType(18, 4), explanation=STRING,
        created_at=TIMESTAMP,
    ),
    "api_logs": _struct(
        id=STRING, endpoint=STRING, method=STRING, status_code=INT, response_time_ms=INT,
        user_id=STRING, ip_address=STRING, created_at=TIMESTAMP,
    ),
    "model_metadata": _struct(
        id=STRING, version=STRING, model_type=STRING, metrics=STRING, hyperparameters=STRING,
        training_date=TIMESTAMP, dataset_size=BIGINT, feature_names=STRING, is_active=BOOLEAN,
        created_at=TIMESTAMP,
    ),
}
