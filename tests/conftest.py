"""One local session for all tests, and the comparison with DuckDB."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for path in sorted(Path(DATA).glob("*.parquet")):
        db.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return db


def plain(value):
    """A value that compares and sorts alike whichever engine it comes from."""
    if value is None:
        return ("", "null")
    if isinstance(value, bool):
        return ("b", str(value))
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return ("n", f"{float(value):.9g}")
    if isinstance(value, (list, tuple)):
        return ("l", str([plain(x) for x in value]))
    return ("s", str(value))


def rows_of(names: list[str], rows) -> tuple[list[str], list]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def same_as_sql(duck):
    """Asserts that a frame has the columns and rows of a DuckDB query."""

    def check(df, sql: str) -> None:
        found = duck.execute(sql)
        names = [c[0] for c in found.description]
        want, got = rows_of(names, found.fetchall()), rows_of(df.columns, df.collect())
        assert got[0] == want[0]
        assert len(got[1]) == len(want[1])
        differ = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
        assert not differ, f"{len(differ)} rows differ, such as {differ[0]}"

    return check
