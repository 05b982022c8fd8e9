import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from leadloom.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", 4, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def page(spark):
    """One parsed page out of an HTML text."""
    from leadloom.operators.pages import parse_pages

    def build(html, url="https://acme.example/", **extra):
        row = {"company_id": 1, "page_id": 1, "url": url, "html": html, **extra}
        names = ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'string'}" for k, v in row.items())
        return parse_pages(spark.createDataFrame([tuple(row.values())], names), keep_html=True)

    return build
