"""Per-entry plugins: a state that sees the entries one by one, kept by key and merged over tasks.

An ``Accumulator`` says which entry columns it reads, under which key an entry counts (None: not at
all), and how a key's state begins, takes one entry, joins with another state and becomes rows.
``accumulator_plugin`` turns any number of them into one plugin of the analyzer:

    LogAnalyzer(lines, opts, plugins={"Activity": accumulator_plugin({"busiest": BusiestMinute()})})

How it runs: one pass over the entries for all accumulators. Each task holds the states of its own
entries by key (at most ``KEYS_HELD``, then it hands them on and starts anew). The partial states
are merged twice, first by (key, salt), then by key: sorted by key and streamed, so a task holds one
state at a time, and a key that every task has seen is merged by ``SALTS`` tasks before one.

``merge`` has to be associative and commutative, and results must not depend on the order of the
entries: tasks, and reruns of lost ones, see them in any order. States are pickled. A key is a tuple
of strings, integers, booleans, dates or timestamps, each of which may be null; equal keys are one.
What a single state holds is up to the accumulator: put whatever grows with the log into the key.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from logarbor.operators.plugins import Plugin
from logarbor.sinks.tables import kept_table

KEYS_HELD = 50_000  # states that a task holds before it hands them on
SALTS = 32
BATCH_STATES = 1_000  # states in a batch between tasks


class Accumulator:
    """``reads``: entry columns; ``keys`` and ``results``: the columns of a key and of the result, as DDL."""

    reads: tuple[str, ...] = ()
    keys: str = ""
    results: str = ""

    def key(self, entry: dict) -> tuple | None:
        raise NotImplementedError

    def zero(self):
        raise NotImplementedError

    def update(self, state, entry: dict):
        """The state after one more entry (may change ``state`` and return it)."""
        raise NotImplementedError

    def merge(self, a, b):
        raise NotImplementedError

    def result(self, state) -> Iterable[tuple]:
        """Rows of ``results``; the key's columns come before them."""
        raise NotImplementedError


def _key_fields(acc: Accumulator) -> list[T.StructField]:
    return T.StructType.fromDDL(acc.keys).fields


def _state_schema(accs: list[Accumulator]) -> T.StructType:
    """(acc, k0, k1, ..., state): the key of accumulator i is the struct ki, the others are null."""
    keys = [T.StructField(f"k{i}", T.StructType(_key_fields(acc))) for i, acc in enumerate(accs)]
    return T.StructType([T.StructField("acc", T.IntegerType()), *keys, T.StructField("state", T.BinaryType())])


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH_STATES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _named(accs: list[Accumulator]) -> list[list[str]]:
    return [[f.name for f in _key_fields(acc)] for acc in accs]


def partial_states(entries: DataFrame, accs: list[Accumulator], keys_held: int = KEYS_HELD) -> DataFrame:
    """The states of each task's own entries: (acc, k0.., state), a key once or more."""
    schema = _state_schema(accs)
    arrow, names = to_arrow_schema(schema), _named(accs)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        states: dict[tuple, object] = {}

        def handed_on() -> Iterator[dict]:
            for (i, key), state in states.items():
                yield {"acc": i, f"k{i}": dict(zip(names[i], key)), "state": pickle.dumps(state)}
            states.clear()

        for batch in batches:
            for entry in batch.to_pylist():
                for i, acc in enumerate(accs):
                    key = acc.key(entry)
                    if key is None:
                        continue
                    at = (i, tuple(key))
                    if at not in states:
                        if len(states) >= keys_held:
                            yield from handed_on()
                        states[at] = acc.zero()
                    states[at] = acc.update(states[at], entry)
        yield from handed_on()

    read = sorted({c for acc in accs for c in acc.reads})
    # without a column to read, rows would have nothing to travel in
    chosen = entries.select(*read) if read else entries.select(F.lit(True).alias("entry"))
    return chosen.mapInArrow(lambda batches: _batches(rows(batches), arrow), schema)


def merged_states(partials: DataFrame, accs: list[Accumulator], salts: int = SALTS) -> DataFrame:
    """One state a key: merged by (key, salt), then by key."""
    schema = partials.schema
    arrow, keys = to_arrow_schema(schema), [f"k{i}" for i in range(len(accs))]

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        held, state = None, None
        for batch in batches:
            for row in batch.to_pylist():
                mine = pickle.loads(row["state"])
                at = (row["acc"], row[f"k{row['acc']}"])
                if held is not None and at == held:
                    state = accs[at[0]].merge(state, mine)
                    continue
                if held is not None:
                    yield {"acc": held[0], f"k{held[0]}": held[1], "state": pickle.dumps(state)}
                held, state = at, mine
        if held is not None:
            yield {"acc": held[0], f"k{held[0]}": held[1], "state": pickle.dumps(state)}

    def by(df: DataFrame, *dealt: str) -> DataFrame:
        return (df.repartition("acc", *keys, *dealt).sortWithinPartitions("acc", *keys).select(*schema.names)
                .mapInArrow(lambda batches: _batches(rows(batches), arrow), schema))

    salted = partials.withColumn("salt", F.spark_partition_id() % salts)
    return by(by(salted, "salt"))


def result_rows(states: DataFrame, accs: list[Accumulator], i: int) -> DataFrame:
    """The rows of accumulator ``i``: its key's columns, then its result's."""
    acc = accs[i]
    fields = _key_fields(acc)
    results = T.StructType.fromDDL(acc.results).fields
    schema = T.StructType([*fields, *results])
    arrow = to_arrow_schema(schema)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                for out in acc.result(pickle.loads(row["state"])):
                    yield {**row["key"], **{f.name: v for f, v in zip(results, out)}}

    mine = states.where(F.col("acc") == i).select(F.col(f"k{i}").alias("key"), "state")
    return mine.mapInArrow(lambda batches: _batches(rows(batches), arrow), schema)


def accumulate(entries: DataFrame, accumulators: dict[str, Accumulator], keys_held: int = KEYS_HELD,
               salts: int = SALTS) -> dict[str, DataFrame]:
    """name -> rows, all from one pass over ``entries`` (merged states of several are kept as a table)."""
    accs = list(accumulators.values())
    if not accs:
        return {}
    states = merged_states(partial_states(entries, accs, keys_held), accs, salts)
    if len(accs) > 1:
        states = kept_table(states, "plugin-states")
    return {name: result_rows(states, accs, i) for i, name in enumerate(accumulators)}


def accumulator_plugin(accumulators: dict[str, Accumulator]) -> Plugin:
    return lambda entries: accumulate(entries, accumulators)


class BusiestMinute(Accumulator):
    """By service: entries, minutes with an entry, and the minute with most of them (ties: the earliest).

    A state holds one number for each minute of the day window that has an entry.
    """

    reads = ("service", "timestamp")
    keys = "service string"
    results = "n bigint, active_minutes bigint, busiest timestamp_ntz, busiest_n bigint"

    def key(self, entry):
        return (entry["service"],)

    def zero(self):
        return Counter()

    def update(self, state, entry):
        state[entry["timestamp"].replace(second=0, microsecond=0)] += 1
        return state

    def merge(self, a, b):
        a.update(b)
        return a

    def result(self, state):
        busiest, n = min(state.items(), key=lambda x: (-x[1], x[0]))
        yield sum(state.values()), len(state), busiest, n
