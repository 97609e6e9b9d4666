import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("ledgerloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate Column functions on one row of named text values."""

    def evaluate(*columns, **values):
        schema = ", ".join(f"{k} string" for k in values) or "x string"
        row = spark.createDataFrame([tuple(values.values()) or ("",)], schema)
        result = row.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
        return result[0] if len(columns) == 1 else tuple(result)

    return evaluate
