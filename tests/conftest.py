import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parent.parent), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


NOW = 1_735_689_600_000_000_000  # 2025-01-01, an hour boundary
HOUR = 3_600_000_000_000
MINUTE = 60_000_000_000


def good(trace, span, **changes):
    return {
        "trace_id": trace, "span_id": span, "start_ns": NOW, "latency_ms": 245, "agent": "agent-1", "model": "gpt-4", "tool": "search",
        "team": "platform", "status": "ok", "tokens_in": 100, "tokens_out": 50, "cost_usd": 0.0015, "payload": '{"k":"v"}',
    } | changes


@pytest.fixture
def store(spark, tmp_path):
    from lumispan.sources.store import SpanStore

    return SpanStore(spark, str(tmp_path / "store"), clock=lambda: NOW + HOUR)
