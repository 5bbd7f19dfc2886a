import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quadrille.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, "tests", **{"spark.sql.shuffle.partitions": "3", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    yield session
    session.stop()


def rows(df, *order):
    """Collected rows as a sorted list of tuples."""
    columns = list(order) or df.columns
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
