"""Every query of the package against its SQL on the smallest tables, and what the others return."""

import os

import pytest

import corpus_pipeline
import firmlake.llm.queries  # noqa: F401
from checks.compare import difference, tables
from firmlake.llm.registry import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    return tables(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    cursor = db.execute(SQL[name])
    wrong = difference([tuple(r) for r in df.collect()], df.columns, cursor.fetchall(), [d[0] for d in cursor.description])
    assert wrong is None, wrong


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")} == set(range(1, 14))


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]
