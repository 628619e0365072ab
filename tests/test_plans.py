"""Physical plan properties the design relies on."""
from datetime import datetime

from logarbor.operators import summary, tree
from logarbor.operators.parse import parse
from logarbor.options import AnalyzerOptions
from logarbor.sources.lens import lens

SF = "/root/testdata/sf0.001"
OPTS = AnalyzerOptions(as_of=datetime(2024, 1, 31), max_days=45)


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_n_uses_window_group_limit(spark):
    p = _plan(tree.first_n(parse(lens(spark, SF), OPTS), 5))
    assert "WindowGroupLimit" in p


def test_top_k_is_take_ordered(spark):
    df = summary.top_k(summary.service_counts(parse(lens(spark, SF), OPTS)), 5)
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().executedPlan().toString()


def test_parse_runs_in_jvm_with_one_regex_pass(spark):
    df = parse(lens(spark, SF), OPTS)
    p = _plan(df)
    assert "Python" not in p and "ArrowEval" not in p
    logical = df._jdf.queryExecution().optimizedPlan().toString()
    assert logical.count("regexp_replace(raw_line") == 4  # per family (month / ISO prefix): ASCII or Unicode form, one runs


def test_scan_prunes_columns(spark):
    df = summary.service_counts(parse(lens(spark, SF), OPTS))
    p = _plan(df)
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,props:string>" in p


def test_tree_rows_limits_before_the_shuffle(spark):
    from logarbor.plans.catalog import QUERIES
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = QUERIES["tree_rows"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "row_number(), 5, Partial" in p and "row_number(), 5, Final" in p
    assert p.count("HashAggregate") >= 2  # partial + final node totals
    assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p


def test_last_k_has_no_global_sort(spark):
    from logarbor.plans.catalog import QUERIES
    for name in ("tail_errors", "tail_matches"):
        p = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject" in p and "rangepartitioning" not in p, name


def test_years_shuffle_no_lines(spark):
    """No branch of the year modes sends a line's text through an exchange, and lines join by equality on small tables."""
    from log_helpers import make_lines
    from logarbor.operators.parse import month_lines
    from logarbor.operators.years import year_changes, year_marks

    lines = make_lines(spark, ["Dec 30 10:00:00 h s: a", "Jan  1 10:00:00 h s: b"] * 5)
    for mode in ("transition", "sequential"):
        opts = OPTS.replace(year_mode=mode, base_year=2023)
        p = parse(lines, opts)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p and "hashpartitioning" not in p
    changes = year_changes(year_marks(month_lines(lines, opts)))
    changes.collect()
    p = changes._jdf.queryExecution().executedPlan().toString()
    for line in p.split("\n"):
        if "Exchange" in line:
            assert "raw_line" not in line and "msg" not in line
    assert "ReusedExchange" in p  # the months are read once for chunks and segments


def test_a_file_of_many_steps_has_no_group_by_file_alone(spark):
    """200,000 steps of one file: arrays are bounded by a segment, windows by file hold one row a chunk."""
    from pyspark.sql import functions as F

    from logarbor.operators import years

    n, chunk, segment = 400_000, 1 << 14, 1 << 10
    months = spark.range(n).selectExpr("concat('f', id % 1) AS file_path", "id % 1 AS block_start", "id AS line_seq",
                                       "if(id % 4 < 2, 'Dec', 'Jan') AS mon")
    marks = years.year_marks(months, chunk)
    changes = years.year_changes(marks, chunk, segment)
    p = _plan(changes.agg(F.max(F.size("steps")), F.count("*")))
    assert "collect_list(" in p
    for line in p.split("\n"):
        if "collect_list(" in line and "Aggregate(" in line:
            assert "segment" in line.split("functions=")[0]
    assert changes.agg(F.max(F.size("steps"))).first()[0] <= segment
    assert years.chunk_carries(marks).count() == -(-n // chunk)
    assert years.line_steps(marks).count() == n // 2 - 1


def test_bad_lines_of_digits_take_linear_time(spark):
    import time

    from log_helpers import make_lines

    line = "2024-01-05T10:00:00." + "1" * 60_000 + "!"
    parse(make_lines(spark, [line[:40]]), OPTS).count()
    t0 = time.time()
    assert parse(make_lines(spark, [line] * 4), OPTS).count() == 0
    assert time.time() - t0 < 20


def test_plans_name_whole_paths(spark, tmp_path):
    where = tmp_path / ("d" * 80) / ("e" * 80) / "landed"
    spark.range(3).write.parquet(str(where))
    assert "landed" in _plan(spark.read.parquet(str(where)))
