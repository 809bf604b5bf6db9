import sys
from contextlib import contextmanager
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def split(spark):
    """``with split(n):`` splits every series of more than n rows."""

    @contextmanager
    def use(rows: int):
        spark.conf.set("sensorlab.slice.rows", str(rows))
        try:
            yield
        finally:
            spark.conf.unset("sensorlab.slice.rows")

    return use


@pytest.fixture(params=["whole", "split"])
def mode(request, split):
    """Run a test with whole series and with series split into slices."""
    if request.param == "whole":
        yield
    else:
        with split(3):
            yield
