"""Shared fixtures: one local session and small literal tables."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortry.plans.session import local_session  # noqa: E402

TESTDATA = "/root/testdata/sf0.001"


def pytest_configure(config):
    for name, text in {
        "slow": "takes long", "integration": "runs several operators together", "unit": "tests one operator",
    }.items():
        config.addinivalue_line("markers", f"{name}: {text}")


def pytest_collection_modifyitems(items):
    for item in items:
        if not any(item.iter_markers()):
            item.add_marker(pytest.mark.unit)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("4", 4, "4g", str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


CLINICAL_ROWS = [
    ("P1", "30", "M", "focal_aware", "4.5", "12", "18.0", "levetiracetam;lamotrigine", "responder"),
    ("P2", "12", "F", "absence", "0.0", "0", "12.0", "", "non_responder"),
    ("P3", "0", "Other", "atonic", "2.0", "0", "0.0", "Topiramate", "partial_responder"),
    ("P4", "121", "F", "absence", "1.0", "5", "1.0", "x", "responder"),
    ("P5", "20", "X", "absence", "-1.0", "5", "1.0", "x", "responder"),
    ("P6", "20", "M", "absence", "abc", "5", "1.0", "x", "responder"),
    ("P7", "20", "M", "absence", "1.0", "5", "1.0", "x", "responder"),
    ("P7", "21", "M", "absence", "1.0", "5", "1.0", "x", "responder"),
    (None, "20", "M", "absence", "1.0", "5", "1.0", "x", "responder"),
    ("P8", "20", "M", "absence", "1.0", "5", "1.0", None, "responder"),
]
CLINICAL_COLUMNS = [
    "patient_id", "age", "sex", "seizure_type", "seizure_frequency_per_month", "age_at_onset",
    "epilepsy_duration_years", "previous_treatments", "treatment_response",
]


@pytest.fixture()
def raw_clinical(spark):
    return spark.createDataFrame(CLINICAL_ROWS, ", ".join(f"{c} string" for c in CLINICAL_COLUMNS))


@pytest.fixture()
def genetic_rows(spark):
    return spark.createDataFrame([
        ("P1", "SCN1A", "p.R1H", "missense", 0.01, "Likely pathogenic"),
        ("P1", "SCN1A", "p.R2H", "missense", 0.02, None),
        ("P1", "BRCA1", "p.R1H", "nonsense", None, "Uncertain significance"),
        ("P2", "TP53", "p.R3H", "synonymous", 0.5, None),
    ], "patient_id string, gene string, variant string, variant_type string, allele_frequency double, "
       "clinvar_significance string")
