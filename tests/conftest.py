from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from riskframe.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "riskframe-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("spark")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=[50_000, 40])
def bucket_rows(request, monkeypatch):
    """Run a test with all rows in one bucket and with many buckets."""
    monkeypatch.setattr("riskframe.plans.ordering.ROWS_PER_BUCKET", request.param)
    return request.param


@pytest.fixture(autouse=True)
def _clear(spark):
    yield
    spark.catalog.clearCache()
