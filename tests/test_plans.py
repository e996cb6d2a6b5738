"""What reaches the scans, and how groupings combine."""

from quorate.operators import release, verdicts
from quorate.plans import verdict_queries
from quorate.sources.tables import table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scan(df):
    return [line for line in plan(df).splitlines() if "FileScan" in line]


def test_scans_read_only_what_is_asked(spark, data):
    for df in (verdict_queries.coverage_by_model(spark, data), verdict_queries.judge_scores(spark, data), verdict_queries.coverage_rollup(spark, data)):
        assert all("raw:string" not in s.split("ReadSchema")[1] and "loaded_at" not in s.split("ReadSchema")[1] for s in scan(df))


def test_filters_reach_the_scan(spark, data):
    rows = verdicts.first_rows(table(spark, data, "experiment").where("condition = 'def_on'"))
    assert any("EqualTo(condition,def_on)" in s for s in scan(rows))


def test_groupings_combine_before_the_shuffle(spark, data):
    text = plan(verdicts.first_rows(table(spark, data, "experiment")))
    assert text.count("HashAggregate") >= 2 and text.count("Exchange hashpartitioning") == 1 and "SortAggregate" not in text


def test_one_shuffle_for_judge_cells_per_grouping(spark, data):
    text = plan(verdicts.judge_cells(table(spark, data, "experiment")))
    assert text.count("Exchange hashpartitioning") == 2


def test_digests_do_not_sort_all_rows(spark, data):
    assert "Exchange SinglePartition" not in plan(release.file_digests(table(spark, data, "shard_lines")))
