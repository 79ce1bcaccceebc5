import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    builder = (
        SparkSession.builder.master("local[8]").appName("crossmer-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Value of one expression over string inputs a and b."""
    def evaluate(build, a="", b=""):
        frame = spark.createDataFrame([(a, b)], "a string, b string")
        from pyspark.sql import functions as F
        return frame.select(build(F.col("a"), F.col("b")).alias("x")).first()["x"]

    return evaluate
