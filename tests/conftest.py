import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from threadloom import session  # noqa: E402

SF = "/root/testdata/sf0.001"
START = datetime(2025, 1, 1)


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "local[4]", 4, **{"spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def at(seconds: float) -> datetime:
    return START + timedelta(seconds=seconds)


def messages(spark, rows):
    """Rows of (tenant, conversation, second, seq, sender, message)."""
    data = [(t, c, at(s), q, who, text) for t, c, s, q, who, text in rows]
    return spark.createDataFrame(
        data, "tenant_id string, conversation_id string, ts timestamp_ntz, seq bigint, "
              "sender string, message string")
