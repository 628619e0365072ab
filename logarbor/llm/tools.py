"""Shared helpers of the training-data operators: tables in the shared folder, row ids, table access."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logarbor.session import checkpoint_dir

# Most rows a frame may have to be offered as a broadcast side; beyond it the join shuffles.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the folder of ``spark.checkpoint.dir``, read back.

    Cuts lineage like ``checkpoint()`` does, but columnar and compressed, and a
    lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_keys(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with two 64-bit hashes of (doc_id, text), under names it does not use; equal for repeated rows alone.

    They join what was computed from a row back to it without a second copy of the text.
    """
    used = {c.lower() for c in df.columns}
    names = []
    for k in range(2):
        name = f"row_key_{k}"
        while name in used:
            name += "_"
        names.append(name)
    return df.withColumns({names[0]: F.xxhash64("doc_id", "text"), names[1]: F.xxhash64("text", "doc_id")}), names


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint on ``df`` if its counted ``rows`` are within ``BROADCAST_ROWS``; else ``df``."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class TwoGenerations(dict):
    """A dict of recent keys and an older one; filling the first drops the second. ``cost`` counts up to ``limit``."""

    def __init__(self, limit: int) -> None:
        super().__init__()
        self.limit, self.cost, self.older = limit, 0, {}

    def find(self, key):
        got = self.get(key)
        if got is None and (got := self.older.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key, value, cost: int = 1) -> None:
        if self.cost >= self.limit:
            self.older = dict(self)
            self.clear()
            self.cost = 0
        self[key] = value
        self.cost += cost
