import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from groundwork import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session.build("tests", cores=8, **{"spark.driver.memory": "6g"})
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
