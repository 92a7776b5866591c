import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import check  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = check.session("8")
    # Tiny inputs: few partitions, and no time spent on generating code.
    session.conf.set("spark.sql.shuffle.partitions", "3")
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    yield session


def rows(df, *columns):
    """The rows of a frame as a sorted list of tuples."""
    names = columns or df.columns
    return sorted((tuple(row[c] for c in names) for row in df.collect()), key=repr)


@pytest.fixture(scope="session")
def table():
    return rows
