from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    import __spark_entry__  # noqa: F401  (ships the package with the tasks)
    from shelfmark import session
    shared = tmp_path_factory.mktemp("shared")
    spark = session.build("local[8]", "shelfmark-tests", 4,
                          **{"spark.checkpoint.dir": str(shared), "spark.driver.memory": "6g"})
    yield spark
    spark.stop()
