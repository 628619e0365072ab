"""Merkle fixity audit of WARC archives over replicas.

Records are hashed where they are read; only (archive, offset, length, digest) rows
travel. Ordered offset ranges of an archive form a tree: a leaf range covers 2**16
bytes and hashes its records' offsets and digests in order, an inner range covers 16
leaf ranges, the root hashes the inner ranges. An audit compares the roots of two
replicas and descends only where they differ: to the inner ranges of those archives,
to the leaf ranges of differing inner ranges, to the records of differing leaf
ranges. No step gathers an archive in one group: a leaf has at most 2**16 bytes of
records, an inner range 16 children, a root one child for each 2**20 bytes.

Nulls: a null url or html is an empty string; rows without an id are dealt to
256 archives of their own by digest. Repeated rows are records of their own, in a row.
An archive or record that only one replica has is reported. Empty replicas agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logarbor.llm.tools import written

VERSION = "WARC/1.0\r\n"
PAGES_PER_ARCHIVE = 1000
LEAF_BYTES = 1 << 16
FANOUT = 16


def record_text(url: str = "url", html: str = "html") -> Column:
    """A WARC response record: header, body, and the two line ends after it."""
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    return F.concat(F.lit(VERSION), F.lit("WARC-Type: response\r\nWARC-Target-URI: "),
                    F.coalesce(F.col(url).cast("string"), F.lit("")), F.lit("\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def _archive(pages_per_archive: int) -> Column:
    """A record's archive by ``page_id``, or by ``digest`` where it has no id."""
    loose = -1 - F.conv(F.substring("digest", 1, 2), 16, 10).cast("bigint")  # one of 256
    return F.coalesce(F.floor(F.col("page_id") / pages_per_archive), loose)


def index(pages: DataFrame, *, pages_per_archive: int = PAGES_PER_ARCHIVE, held: str | None = None) -> DataFrame:
    """archive, page_id, offset, length, digest of each page's record, archives in the order of ids.

    With ``held``, a column of bodies, also ``held``: the digest of the record with that body, in the same row.
    """
    also = [] if held is None else ["held"]
    other = [] if held is None else [F.sha2(record_text(html=held), 256).alias("held")]
    records = (pages.select(F.col("page_id").cast("bigint"), record_text().alias("record"), *other)
               .select("page_id", F.octet_length("record").cast("bigint").alias("length"),
                       F.sha2("record", 256).alias("digest"), *also))
    records = records.withColumn("archive", _archive(pages_per_archive))
    order = Window.partitionBy("archive").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return records.select("archive", "page_id", F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset"),
                          "length", "digest", *also)


def write_warc(pages: DataFrame, path: str, *, pages_per_archive: int = PAGES_PER_ARCHIVE) -> None:
    """One WARC file for each archive, in folders ``archive=<n>``; an archive is one bounded task."""
    rows = (pages.select(F.col("page_id").cast("bigint"), record_text().alias("record"))
            .withColumn("digest", F.sha2("record", 256)).withColumn("archive", _archive(pages_per_archive)))
    line = F.col("record").substr(F.lit(1), F.length("record") - 2)  # the writer adds the last line end
    (rows.repartition("archive").sortWithinPartitions("archive", "page_id", "digest").select("archive", line)
     .write.partitionBy("archive").option("lineSep", "\r\n").text(path))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(archive, offset, length, digest, url, body) of the records in the WARC files under ``path``.

    Files split where a record begins, so a large archive is many tasks. ``archive`` is the file's folder, ``offset``
    the byte where the record begins; only lengths are ordered per file. A body that holds the version line itself
    is cut there, which both replicas of a file do alike.
    """
    raw = (spark.read.option("recursiveFileLookup", "true").option("lineSep", VERSION).text(path)
           .select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("archive"),
                   F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                   F.monotonically_increasing_id().alias("seq")).where("value <> ''"))
    record = F.concat(F.lit(VERSION), "value")
    body = F.substring("value", F.instr("value", F.lit("\r\n\r\n")) + 4, F.length("value"))
    rows = raw.select("archive", "file", "block", "seq", F.octet_length(record).cast("bigint").alias("length"),
                      F.sha2(record, 256).alias("digest"),
                      F.regexp_extract("value", r"(?m)^WARC-Target-URI: ([^\r\n]*)", 1).alias("url"),
                      F.regexp_replace(body, r"\r\n\r\n\z", "").alias("body"))
    order = Window.partitionBy("file").orderBy("block", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("archive", F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset"), "length",
                       "digest", "url", "body")


def file_index(records: DataFrame) -> DataFrame:
    """The record table of ``audit`` from ``read_warc``; its records have no page id."""
    return records.select("archive", F.lit(None).cast("bigint").alias("page_id"), "offset", "length", "digest")


def _node(key: str, value: str) -> Column:
    """Hash of a group's children, 'key:value' in key order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))))
    return F.sha2(F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p["k"].cast("string"), p["v"])), ","), 256)


def tree(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(roots, inner ranges, leaf ranges) of the archives in ``records``."""
    leaf = F.floor(F.col("offset") / LEAF_BYTES)
    leaves = records.withColumn("leaf", leaf).groupBy("archive", "leaf").agg(_node("offset", "digest").alias("hash"))
    inner = (leaves.withColumn("inner", F.floor(F.col("leaf") / FANOUT)).groupBy("archive", "inner")
             .agg(_node("leaf", "hash").alias("hash")))
    roots = inner.groupBy("archive").agg(_node("inner", "hash").alias("hash"))
    return roots, inner, leaves


def _differ(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose hashes differ or that one side lacks."""
    other = b.withColumnRenamed("hash", "other")
    return a.join(other, keys, "full_outer").where(~F.col("hash").eqNullSafe(F.col("other"))).select(*keys)


def audit(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(archives, damages) of two replicas' record tables as from ``index``.

    archives: archive, root_a, root_b. damages: archive, offset, page_id, length and
    kind: 'altered' (digest differs), 'missing' (only in a) or 'extra' (only in b).
    """
    a, b = written(a), written(b)
    trees = [[written(level) for level in tree(side)] for side in (a, b)]
    (roots_a, inner_a, leaves_a), (roots_b, inner_b, leaves_b) = trees
    archives = roots_a.withColumnRenamed("hash", "root_a").join(
        roots_b.withColumnRenamed("hash", "root_b"), "archive", "full_outer")
    bad = archives.where(~F.col("root_a").eqNullSafe(F.col("root_b"))).select("archive")
    bad = _differ(inner_a.join(bad, "archive", "left_semi"), inner_b.join(bad, "archive", "left_semi"),
                  ["archive", "inner"])

    def below(leaves: DataFrame) -> DataFrame:
        return leaves.withColumn("inner", F.floor(F.col("leaf") / FANOUT)).join(
            bad, ["archive", "inner"], "left_semi").drop("inner")

    leaves = _differ(below(leaves_a), below(leaves_b), ["archive", "leaf"])

    def records(side: DataFrame) -> DataFrame:
        return side.withColumn("leaf", F.floor(F.col("offset") / LEAF_BYTES)).join(
            leaves, ["archive", "leaf"], "left_semi").drop("leaf")

    left = records(a)
    right = records(b).select("archive", "offset", F.col("page_id").alias("page_b"), F.col("length").alias("length_b"),
                              F.col("digest").alias("digest_b"))
    damages = (left.join(right, ["archive", "offset"], "full_outer")
               .where(~F.col("digest").eqNullSafe(F.col("digest_b")))
               .select("archive", "offset", F.coalesce("page_id", "page_b").alias("page_id"),
                       F.coalesce("length", "length_b").alias("length"),
                       F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest").isNull(), "extra")
                       .otherwise("altered").alias("kind")))
    return archives, damages
