import datetime as dt

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("panelcast-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def weekly(spark):
    """A small dense panel: three series, 40 weeks, fixed pseudo-random values."""
    import numpy as np

    rng = np.random.default_rng(5)
    start = dt.date(2022, 1, 3)
    rows = []
    for name in ("a", "b", "c"):
        apps = rng.integers(0, 50, 40).astype(float)
        for i in range(40):
            rows.append(
                (
                    start + dt.timedelta(days=7 * i),
                    name,
                    float(apps[i]),
                    float(rng.integers(0, 40)),
                    float(rng.integers(0, 30)),
                )
            )
    from panelcast.schema import PANEL_SCHEMA

    return spark.createDataFrame(rows, PANEL_SCHEMA)
