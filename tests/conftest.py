from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from retally.session import local_session  # noqa: E402

SEED_SCHEMA = (
    "globaleventid long, event_date int, source_actor string, target_actor string,"
    " cameo_code string, num_events int, num_articles int, quad_class int, goldstein double"
)


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        4, app="tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.sql.maxMetadataStringLength": "4000"}
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def folder():
    """A new folder of its own for each test; left in place."""
    return tempfile.mkdtemp(prefix="retally-test-")


@pytest.fixture
def events(spark):
    """Builds an event table from rows of the nine non-position columns."""

    def make(*rows):
        return spark.createDataFrame(list(rows), SEED_SCHEMA)

    return make


@pytest.fixture
def seed(events):
    return events(
        (1, 19790101, "AFR", "FRA", "043", 1, 4, 1, 2.8),
        (2, 19790101, "AFR", "FRA", "050", 2, 9, 1, 3.5),
        (3, 19790101, "ARG", "CHL", "172", 2, 4, 4, -5.0),
        (4, 19790101, "CHN", "CHNGOV", "0841", 1, 6, 2, 7.0),
    )


@pytest.fixture
def values():
    """Rows of a frame as sorted tuples."""

    def get(df, *columns):
        rows = (df.select(*columns) if columns else df).collect()
        return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))

    return get
