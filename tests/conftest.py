import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.log.level", "ERROR")
        .config("spark.sql.warehouse.dir", f"/tmp/tessera-test-warehouse-{os.getpid()}")
        .getOrCreate()
    )
    yield s
    s.stop()


@pytest.fixture
def engine(spark, tmp_path):
    from tessera.engine import Engine

    return Engine(spark, str(tmp_path / "db"))
