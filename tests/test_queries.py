"""Every query with SQL against DuckDB on the smallest data; the others must run and have a stable schema."""

import pytest

from quorate.plans import assembly_queries, drift_queries, item_queries, stream_queries, verdict_queries

MODULES = [verdict_queries, item_queries, drift_queries, stream_queries, assembly_queries]
#: Queries whose columns follow from the data; their SQL states those of scale 0.01.
LARGER = {"p1_records": "/root/testdata/sf0.01"}
CASES = [(m, n) for m in MODULES for n in m.QUERIES]


@pytest.mark.parametrize(("module", "name"), CASES, ids=[n for _, n in CASES])
def test_query(module, name, spark, data, same, sound):
    if name in module.SQL:
        same(module, name, LARGER.get(name, data))
    else:
        df = module.QUERIES[name](spark, data)
        sound(df)
        assert df.columns and df.count() > 0


def test_names_are_unique():
    names = [n for m in MODULES for n in m.QUERIES]
    assert len(names) == len(set(names))
    assert all(n in m.QUERIES for m in MODULES for n in m.SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
