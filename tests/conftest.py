import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from marketspark.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("checkpoints"))
    s = session(
        "tests", "local[4]", 4,
        **{"spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": folder},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
