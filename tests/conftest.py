"""One session for all tests."""

import os

import pytest
from pyspark.sql import SparkSession

os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SNAPSHOT = "docid string, sub_collection string, text_fr string, url string, crawl_dates string, delivered_at timestamp_ntz"


@pytest.fixture(scope="session")
def snapshot(spark):
    """Builds a document_snapshot from (docid, sub_collection, text, url, day) with columns whose names clash with inner ones."""
    import datetime

    from pyspark.sql import functions as F

    def make(rows):
        full = [(d, s, t, u, None, None if k is None else datetime.datetime(2023, 1, 1) + datetime.timedelta(days=k)) for d, s, t, u, k in rows]
        df = spark.createDataFrame(full, SNAPSHOT)
        for c in ("text", "host", "fp", "seen", "_rn", "words", "id", "name", "line"):
            df = df.withColumn(c, F.lit("clash"))
        return df

    return make
