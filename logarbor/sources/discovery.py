"""Finding the log to read: candidate names, rotations, latest by modification time.

The base folder is a parameter (no host path is assumed). Listing uses the
``binaryFile`` source without reading content.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from logarbor.sources.files import list_files

# Default log names, rotation suffixes and compression suffixes.
DEFAULT_LOG_NAMES = ("messages", "syslog", "system.log", "auth.log", "secure", "kern.log", "dmesg", "debug")
ROTATION_SUFFIXES = (".1", ".2", ".3", ".0")
COMPRESSION_SUFFIXES = (".gz", ".bz2", ".xz")
DATED_DAYS = 7


def rotation_names(name: str, as_of: datetime) -> list[str]:
    """name, name.1 .2 .3 .0, name-YYYYMMDD for the last 7 days, and .gz/.bz2/.xz of each."""
    base = [name] + [name + s for s in ROTATION_SUFFIXES]
    base += [f"{name}-{(as_of - timedelta(days=i)).strftime('%Y%m%d')}" for i in range(DATED_DAYS)]
    return base + [b + c for b in base for c in COMPRESSION_SUFFIXES]


def candidates(spark: SparkSession, base_dir: str, as_of: datetime,
               names: tuple[str, ...] = DEFAULT_LOG_NAMES) -> DataFrame:
    """Existing candidate files under base_dir: (path, name, modificationTime, length)."""
    wanted = {n: base for base in names for n in rotation_names(base, as_of)}
    listing = list_files(spark, base_dir).withColumn("name", F.element_at(F.split("path", "/"), -1))
    keep = F.col("name").isin(*wanted.keys())
    log_of = F.create_map(*[x for k, v in wanted.items() for x in (F.lit(k), F.lit(v))])
    return listing.filter(keep).withColumn("log", log_of[F.col("name")])


def latest_log(spark: SparkSession, base_dir: str, as_of: datetime,
               names: tuple[str, ...] = DEFAULT_LOG_NAMES) -> str | None:
    """Path of the most recently modified candidate (None when there is none or the folder is missing)."""
    try:
        row = candidates(spark, base_dir, as_of, names).agg(F.max_by("path", "modificationTime").alias("p")).first()
    except AnalysisException:
        return None
    return row.p if row else None


def rotation_set(spark: SparkSession, base_dir: str, name: str, as_of: datetime) -> list[str]:
    """All existing rotations of one log, to be read together as one input."""
    return [r.path for r in candidates(spark, base_dir, as_of, (name,)).select("path").collect()]
