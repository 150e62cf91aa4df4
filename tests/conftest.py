import datetime as dt
import os

import numpy as np
import pytest

from contestlab.session import build_session

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def skewed(spark):
    """Side-like rows where entity 1 holds most of the table, with ties, nulls and same-day rows."""
    rng = np.random.default_rng(7)
    rows = []
    for e, n in ((1, 500), (2, 60), (3, 1)):
        for i in range(n):
            d = dt.date(2000, 1, 1) + dt.timedelta(days=int(rng.integers(0, 400)))
            x = None if rng.random() < 0.05 else float(rng.normal() * 10) if rng.random() < 0.6 else float(rng.integers(0, 5))
            rows.append((e, i, d, x, float(i if e == 1 else -i)))
    df = spark.createDataFrame(rows, "entity_id bigint, contest_id bigint, event_date date, x double, y double")
    df.cache().count()
    return df
