import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    shared = tempfile.mkdtemp(prefix="spark-tests-")
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", shared).config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


def plan_is_sound(df):
    """No cross or nested-loop join in the plan that would run."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, plan


@pytest.fixture(scope="session")
def sound():
    return plan_is_sound


@pytest.fixture(scope="session")
def same(spark):
    """Check a query of a module against its SQL over the same tables."""
    import math

    import duckdb

    def tables(folder):
        con = duckdb.connect()
        for p in sorted(Path(folder).glob("*.parquet")):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        return con

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else float(f"{v:.9g}")
        return int(v) if isinstance(v, bool) else v

    def check(module, name, folder=DATA):
        con = tables(folder)
        df = module.QUERIES[name](spark, folder)
        plan_is_sound(df)
        cols = sorted(df.columns)
        got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
        rel = con.execute(module.SQL[name])
        names = [x[0] for x in rel.description]
        assert sorted(names) == cols
        want = [tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()]
        key = lambda r: tuple((x is None, str(x)) for x in r)
        assert sorted(got, key=key) == sorted(want, key=key)

    return check
