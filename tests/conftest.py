import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from listprep.session import local_session

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def rows(spark):
    """Rows of a DataFrame with a text-only schema, from tuples."""

    def make(columns: str, *values: tuple):
        schema = ", ".join(f"`{name.strip()}` string" for name in columns.split(","))
        return spark.createDataFrame(list(values), schema)

    return make


def column(df, name: str, order: str = "row_id") -> list:
    return [row[0] for row in df.orderBy(order).select(f"`{name}`").collect()]
