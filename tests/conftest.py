import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lodestar.session import get_session

    session = get_session("local[4]", "tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """The value of a column expression over one row of given columns."""

    def value(make, **columns):
        names = list(columns) or ["x"]
        schema = ", ".join(f"`{n}` {'array<string>' if isinstance(v, list) else 'string'}" for n, v in columns.items()) or "x int"
        row = spark.createDataFrame([tuple(columns.values()) or (1,)], schema)
        from pyspark.sql import functions as F

        return row.select(make(*(F.col(n) for n in names))).first()[0]

    return value
