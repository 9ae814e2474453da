from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from webtables.session import build_session

    session = build_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "8"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def dom_of(spark):
    """Parse pages given as HTML texts; `page_id` is the position."""
    from webtables.sources.dom import parse_pages

    def parse(*pages, detail=False):
        return parse_pages(spark.createDataFrame(list(enumerate(pages)), "page_id BIGINT, html STRING"), detail)

    return parse


@pytest.fixture
def pages_of(spark):
    def make(*pages):
        rows = [(i, f"https://x.example/{i}", html) for i, html in enumerate(pages)]
        return spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")

    return make
