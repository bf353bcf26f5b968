import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from docmill.session import build_session

    session = build_session("tests", master="local[4]", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a Column over a single row of named text values."""
    from pyspark.sql import functions as F

    def run(column, **values):
        df = spark.range(1)
        for name, value in values.items():
            df = df.withColumn(name, F.lit(value))
        return df.select(column.alias("r")).first().r
    return run
