"""Registered queries against DuckDB on the smallest data set."""

import os

import pytest

import __spark_entry__ as entry
from compare import canonical, connect

SF_DIR = "/root/testdata/sf0.001"
NAMES = [
    "tb01_ds_icd", "tb04_ds_readmission", "tb07_pretrain_fhir", "ag02_merge_linked_patients", "ag04_history_text",
    "jn06_history_bounds", "jn08_followed_by", "sp05_label_covering_split", "src02_flatten_encounter",
    "src12_flatten_bdp", "cf10_report_cohort", "tx01_chunk_text", "ag15_classification_metrics", "ag17_ranking_metrics",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_equals_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(df.collect(), df.columns) == canonical(cur.fetchall(), names)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
