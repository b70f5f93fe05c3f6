from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from log_fixtures import NOW  # noqa: E402
from sparklog.session import build_session, scratch_path  # noqa: E402
from sparklog.sources.log_table import create_log_table  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def log_table(spark):
    """A fresh, empty log table."""
    path = scratch_path(spark, "db")
    database = "t_" + path.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {database} LOCATION '{path}'")
    create_log_table(spark, f"{database}.logs")
    return f"{database}.logs"


@pytest.fixture
def scratch(spark):
    return lambda name: scratch_path(spark, name)


@pytest.fixture
def make_logs(spark):
    """Log rows from short dicts; what is left out gets a plain default."""
    from sparklog.functions.times import utc_day
    from sparklog.schema import LOG_SCHEMA
    from pyspark.sql import functions as F

    def make(rows):
        filled = []
        for i, row in enumerate(rows):
            base = {f.name: None for f in LOG_SCHEMA.fields if f.name != "day"}
            base |= {
                "record_id": f"r{i:06d}",
                "time_ns": NOW,
                "severity": 9,
                "service": "x",
                "instance": "h",
                "message": "m",
            }
            base |= row
            base["ingest_ns"] = row.get("ingest_ns", base["time_ns"])
            filled.append(tuple(base.values()))
        schema = type(LOG_SCHEMA)([f for f in LOG_SCHEMA.fields if f.name != "day"])
        df = spark.createDataFrame(filled, schema)
        return df.withColumn("day", utc_day(F.col("time_ns")))

    return make
