import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from veilspark.session import build_session  # noqa: E402
from veilspark.streaming import settled, streams  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        **{
            "spark.master": "local[4]",
            "spark.driver.memory": "4g",
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def checkpoints(monkeypatch, tmp_path_factory):
    """Streams of each test in a folder of its own: tests share a session and some names of streams."""
    folder = str(tmp_path_factory.mktemp("streams"))
    for module in (settled, streams):
        monkeypatch.setattr(module, "checkpoint_root", lambda spark: folder)


@pytest.fixture
def texts(spark):
    """A DataFrame ``(id, text)`` of the given strings."""

    def build(*values):
        return spark.createDataFrame(list(enumerate(values)), "id int, text string")

    return build


@pytest.fixture
def one(spark):
    """The value of a column expression that needs no input."""
    return lambda column: spark.range(1).select(column.alias("x")).first()["x"]
