import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from checks.compare import test_session

    return test_session()


@pytest.fixture()
def evaluate(spark):
    """Value of a column expression over one row given as keyword columns."""
    from pyspark.sql import functions as F

    def run(make, schema, *rows):
        df = spark.createDataFrame(list(rows), schema)
        return [r[0] for r in df.select(make(*[F.col(c) for c in df.columns])).collect()]

    return run
