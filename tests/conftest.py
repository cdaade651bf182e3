import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lendscape.session import drop_stored, tune  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("lendscape-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    drop_stored(session)
    session.stop()


@pytest.fixture
def frame(spark):
    """A frame of text rows: ``frame("a, b", [(..), (..)])``, every column a string."""

    def make(columns, rows):
        names = [c.strip() for c in columns.split(",")]
        return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{n} string" for n in names))

    return make
