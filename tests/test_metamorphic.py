"""Metamorphic relations: reading, splitting and filtering in different ways gives the same entries."""
import gzip
from datetime import datetime

from logarbor.operators.parse import parse
from logarbor.operators.search import filter_logs
from logarbor.options import AnalyzerOptions
from logarbor.sources.files import read_lines
from logarbor.sources.lens import lens

OPTS = AnalyzerOptions(as_of=datetime(2024, 1, 31), max_days=45)
SF = "/root/testdata/sf0.001"
KEY = ["timestamp", "service", "message", "level", "host", "pid", "format", "is_error"]


def _lens_text(spark):
    return [r.value for r in lens(spark, SF).orderBy("line_seq").select("value").collect()]


def test_split_into_files_any_way(spark, tmp_path):
    text = _lens_text(spark)
    whole = tmp_path / "whole"
    whole.mkdir()
    (whole / "all.log").write_text("\n".join(text) + "\n")
    parts = tmp_path / "parts"
    parts.mkdir()
    for k in range(4):  # interleaved, compressed and plain
        body = ("\n".join(text[k::4]) + "\n").encode()
        if k % 2:
            with gzip.open(parts / f"p{k}.log.gz", "wb") as fh:
                fh.write(body)
        else:
            (parts / f"p{k}.log").write_bytes(body)
    a = sorted(parse(read_lines(spark, str(whole)), OPTS).select(KEY).collect())
    b = sorted(parse(read_lines(spark, str(parts)), OPTS).select(KEY).collect())
    c = sorted(parse(lens(spark, SF), OPTS).select(KEY).collect())
    assert a == b == c


def test_filters_compose(spark):
    e = parse(lens(spark, SF), OPTS)
    both = filter_logs(e, service_pattern="n", message_contains="user")
    chained = filter_logs(filter_logs(e, service_pattern="n"), message_contains="user")
    assert sorted(both.select(KEY).collect()) == sorted(chained.select(KEY).collect())
    lvl = filter_logs(e, level="ERROR").count()
    assert lvl == e.filter("level = 'ERROR'").count()
