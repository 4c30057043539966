import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _small_ranges(monkeypatch, bounds):
    from rankeval.operators import ranges

    monkeypatch.setattr(ranges, "PLAN", ranges.RangePlan(rows=24, sample=3, bounds=bounds))


@pytest.fixture
def split_everything(monkeypatch):
    """Treat every group of a few rows as large, so that the range path runs on small data."""
    _small_ranges(monkeypatch, 4096)


@pytest.fixture
def split_shuffled(monkeypatch):
    """As ``split_everything``, with few splitters broadcast and the others joined by shuffle."""
    _small_ranges(monkeypatch, 3)
