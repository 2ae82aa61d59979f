import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from usagelens.session import configure

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def make_events(spark):
    """Events from dicts; columns not given are NULL, event_ts follows event_timestamp."""
    from pyspark.sql import functions as F

    from usagelens.schema import EVENTS

    def make(rows):
        given = [tuple(row.get(c) for c in EVENTS.names) for row in rows]
        df = spark.createDataFrame(given, EVENTS)
        return df.withColumn("event_ts", F.col("event_timestamp").try_cast("timestamp"))

    return make
