import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[1]}:{os.environ.get('PYTHONPATH', '')}"
    shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    s = (
        SparkSession.builder.master(os.environ.get("TEST_MASTER", "local[*]"))
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"{shared}/checkpoint").config("spark.sql.warehouse.dir", f"{shared}/warehouse")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p if p.is_file() else str(p) + '/*.parquet'}')")
    return c


def same_rows(df, duck, sql):
    """Both results as sorted lists of rows, columns by name, numbers to nine digits."""
    def plain(v):
        return f"{v:.9g}" if isinstance(v, float) else "null" if v is None else str(v)

    columns = sorted(df.columns)
    ours = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    got = duck.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in got.fetchall())
    return ours, theirs
