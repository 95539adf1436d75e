import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.compare import session  # noqa: E402
from graphreports.runtime import configure  # noqa: E402


os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [sys.path[0], os.environ.get("PYTHONPATH")]))  # for Python workers


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = configure(session("4"))
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return spark


@pytest.fixture
def rows(spark):
    """Frame of tuples: ``rows("a string, b int", ("x", 1))``."""
    return lambda schema, *data: spark.createDataFrame(list(data), schema)
