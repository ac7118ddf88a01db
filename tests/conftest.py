import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from joblume.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, app="tests", memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def apply(spark):
    """Values of a column expression over a list of inputs."""
    from pyspark.sql import functions as F

    def run(values, expression, type="string"):
        rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {type}")
        return [r[0] for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").select("y").collect()]
    return run
