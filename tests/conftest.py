from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
for path in (ROOT, ROOT / "tests"):
    if str(path) not in sys.path:
        sys.path.insert(0, str(path))
# Worker processes unpickle the stub models by module name.
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), str(ROOT / "tests"), os.environ.get("PYTHONPATH", "")])

from paceline.session import build_session, drop_scratch  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="6g",
        spark__driver__host="127.0.0.1",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_scratch(session)
    session.stop()


@pytest.fixture
def column(spark):
    """Values of a column expression over rows of `text`."""

    def values(expression, texts):
        rows = [(i, text) for i, text in enumerate(texts)]
        frame = spark.createDataFrame(rows, "i int, text string")
        return [row[0] for row in frame.select(expression.alias("v"), "i").orderBy("i").collect()]

    return values
