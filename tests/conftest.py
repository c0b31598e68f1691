import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from querygrove.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


def statements(spark, texts, role="query", dialect="postgres"):
    rows = [(i, 0, 1, "sql", role, dialect, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "unit_id long, stmt_idx int, repo long, input_kind string, input_role string, dialect string, sql string")
