"""Per-entry plugins against one process that sees all entries in a row."""
import json
import random
import sys
from collections import Counter
from datetime import datetime, timedelta

from pyspark import cloudpickle
from pyspark.sql import functions as F

from logarbor.operators.accumulators import (Accumulator, BusiestMinute, accumulate, accumulator_plugin, merged_states,
                                             partial_states)
from logarbor.operators.clusters import error_clusters_by_service, error_pattern
from logarbor.operators.parse import parse
from logarbor.options import AnalyzerOptions
from logarbor.plans.analyzer import LogAnalyzer
from logarbor.sources.lens import lens

SF = "/root/testdata/sf0.001"
OPTS = AnalyzerOptions(as_of=datetime(2024, 1, 31), max_days=45)

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test module


class CountErrors(Accumulator):
    reads = ("service", "pattern", "is_error")
    keys = "service string, pattern string"
    results = "n bigint"

    def key(self, entry):
        return (entry["service"], entry["pattern"]) if entry["is_error"] else None

    def zero(self):
        return 0

    def update(self, state, entry):
        return state + 1

    def merge(self, a, b):
        return a + b

    def result(self, state):
        return [(state,)]


class Extremes(Accumulator):
    """All entries under one key of two columns, one of them null; several rows of result, or none."""

    reads = ("pid", "host")
    keys = "pid string, day date"
    results = "kind string, host string"

    def key(self, entry):
        return entry["pid"], None

    def zero(self):
        return []

    def update(self, state, entry):
        return self.merge(state, [entry["host"] or ""])

    def merge(self, a, b):
        both = sorted({*a, *b})
        return both if len(both) < 2 else [both[0], both[-1]]

    def result(self, state):
        if state[0]:
            yield "first", state[0]
            yield "last", state[-1]


class Rows(Accumulator):
    """Reads no column at all."""

    keys = "one int"
    results = "n bigint"

    def key(self, entry):
        return (1,)

    zero = CountErrors.zero
    update = CountErrors.update
    merge = CountErrors.merge
    result = CountErrors.result


def one_process(entries, acc):
    """What a loop over all entries gives."""
    states = {}
    for entry in entries:
        key = acc.key(entry)
        if key is not None:
            states[key] = acc.update(states[key] if key in states else acc.zero(), entry)
    return Counter((*key, *row) for key, state in states.items() for row in acc.result(state))


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def entries_of(spark):
    return parse(lens(spark, SF, partitions=7), OPTS)


def test_several_accumulators_in_one_pass_equal_one_process(spark):
    entries = entries_of(spark).withColumn("pattern", error_pattern(F.col("message")))
    listed = [r.asDict() for r in entries.collect()]
    random.Random(3).shuffle(listed)
    accs = {"errors": CountErrors(), "busiest": BusiestMinute(), "ends": Extremes(), "rows": Rows()}
    got = accumulate(entries, accs)
    for name, acc in accs.items():
        assert rows(got[name]) == one_process(listed, acc), name
    assert rows(got["errors"]) == rows(error_clusters_by_service(entries).select("service", "pattern", "n"))
    assert got["ends"].columns == ["pid", "day", "kind", "host"]


def test_states_handed_on_early_and_any_salt(spark):
    entries = entries_of(spark)
    accs = [BusiestMinute()]
    whole = rows(accumulate(entries, {"b": accs[0]})["b"])
    partials = partial_states(entries, accs, keys_held=1)
    services = entries.select("service").distinct().count()
    assert partials.count() > 7 * services  # a task hands the same key on more than once
    for salts in (1, 2, 64):
        assert merged_states(partials, accs, salts).count() == services
        assert rows(accumulate(entries, {"b": accs[0]}, keys_held=1, salts=salts)["b"]) == whole


def test_one_key_with_most_rows_reaches_the_merge_as_one_state_a_task(spark):
    start = datetime(2024, 1, 1)
    entries = spark.range(0, 20_000, numPartitions=8).select(
        F.when(F.col("id") % 10 < 9, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("service"),
        F.timestamp_add("SECOND", (F.col("id") % 600).cast("int"), F.lit(start).cast("timestamp_ntz")).alias("timestamp"))
    partials = partial_states(entries, [BusiestMinute()])
    assert partials.where("k0.service = 'hot'").count() == 8
    hot = accumulate(entries, {"b": BusiestMinute()})["b"].where("service = 'hot'").collect()
    counts = Counter(start + timedelta(minutes=i % 600 // 60) for i in range(20_000) if i % 10 < 9)
    busiest = min(counts, key=lambda m: (-counts[m], m))
    assert [tuple(r) for r in hot] == [("hot", 18_000, 10, busiest, counts[busiest])]


def test_no_entries_and_no_accumulators(spark):
    entries = entries_of(spark).where("false")
    got = accumulate(entries, {"a": BusiestMinute(), "b": Rows()})
    assert got["a"].count() == 0 and got["b"].count() == 0 and got["b"].columns == ["one", "n"]
    assert accumulate(entries, {}) == {}


def test_accumulators_in_the_exported_report(spark, tmp_path):
    a = LogAnalyzer(lens(spark, SF, partitions=4), OPTS,
                    plugins={"Activity": accumulator_plugin({"busiest": BusiestMinute()})})
    doc = json.loads(a.json_report().toJSON().first())
    shown = doc["plugin_results"]["Activity"]["busiest"]
    assert shown and set(shown[0]) == {"service", "n", "active_minutes", "busiest", "busiest_n"}
    assert any("Activity busiest" in r.text for r in a.summary_lines().collect())
