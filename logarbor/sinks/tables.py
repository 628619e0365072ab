"""Tables kept in the shared checkpoint folder: they cut lineage and are computed once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from logarbor.session import checkpoint_dir


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the folder of ``spark.checkpoint.dir``, read back.

    Unlike ``checkpoint()``, which runs its plan twice, it is one job, and the planner knows
    the table's size when it chooses a join.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
