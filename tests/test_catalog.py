"""Registered jobs against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from check import compare, duck

FOLDER = "/root/testdata/sf0.001"
JOBS, TEXTS = contract.queries(), contract.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not there")

# One job per family; check.py runs all of them.
SAMPLE = [
    "who_said_what",
    "turns_merged_g2",
    "speech_regions_v1",
    "regions_merged_v2_v3",
    "words_to_turns_j1",
    "segments_to_turns_j2",
    "timestamp_pieces_g9",
    "hypothesis_choice_q1",
    "language_vote_q3",
    "neighbour_edges_c5_o3",
    "job_routing_p10_p11",
    "stage_metrics_r4",
]


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_sql_belongs_to_a_job():
    assert set(TEXTS) <= set(JOBS)


@pytest.mark.parametrize("name", SAMPLE)
def test_job_equals_sql(spark, con, name):
    df = JOBS[name](spark, FOLDER)
    answer = con.execute(TEXTS[name])
    columns = [d[0] for d in answer.description]
    assert compare([tuple(r) for r in df.collect()], df.columns, answer.fetchall(), columns) == ""


def test_entry(spark):
    assert contract.entry(spark).count() > 0
