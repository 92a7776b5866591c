"""Every registered query next to its SQL, at the smallest scale."""

import pytest

import __spark_entry__ as registered
import check

FOLDER = "/root/testdata/sf0.001"

# The text operators' queries have tests of their own.
NAMES = [n for n in registered.queries() if n != "pipeline" and not n.startswith("op")]


@pytest.fixture(scope="module", autouse=True)
def generated_code(spark):
    """Queries run as they do elsewhere; the other tests leave code generation out to be quick."""
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    yield
    spark.conf.set("spark.sql.codegen.wholeStage", "false")


@pytest.fixture(scope="module")
def connection():
    return check.database(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, connection, name):
    outcome, *_ = check.compare(spark, connection, name, FOLDER)
    assert outcome == "ok"


def test_entry(spark):
    assert registered.entry(spark).count() > 0
    assert set(registered.oracle_sql()) <= set(registered.queries())
