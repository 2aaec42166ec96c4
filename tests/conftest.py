from __future__ import annotations

import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from meterwise.clock import Clock  # noqa: E402
from meterwise.config import Config  # noqa: E402
from meterwise.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = build_session(
        "tests",
        "local[4]",
        4,
        {"spark.sql.warehouse.dir": str(base / "warehouse"), "spark.checkpoint.dir": str(base / "shared")},
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def clock():
    return Clock(datetime(2024, 1, 31))


@pytest.fixture
def cfg():
    return Config()


@pytest.fixture
def frame(spark):
    """Rows of text and numbers under a schema whose times may be written as text."""

    def build(rows: list[tuple], schema: str):
        from pyspark.sql import functions as F

        fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
        times = {name: kind for name, kind in fields if kind in ("timestamp", "date")}
        plain = ", ".join(f"{n} {'string' if n in times else k}" for n, k in fields)
        df = spark.createDataFrame(rows, plain)
        return df.select(*[F.col(n).cast(k).alias(n) for n, k in fields])

    return build


def rows_of(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
