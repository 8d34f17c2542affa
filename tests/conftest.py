import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("sweepframe-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.log.level", "ERROR")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-test-", dir="/tmp"))
        .getOrCreate()
    )
    yield session
    session.stop()


@pytest.fixture
def small_groups(spark):
    """Every group counts as large, so the plans for skewed keys run."""
    settings = {"spark.sweepframe.groupRows": "25", "spark.sweepframe.boxesPerRow": "4"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k in settings:
        spark.conf.unset(k)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
