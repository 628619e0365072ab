import hashlib

import duckdb
import pytest
from helpers import with_clashing_columns
from pyspark.sql import functions as F

from logarbor.llm import warc_fixity as wf
from logarbor.llm.queries import ORACLE, QUERIES

PAGES = "page_id bigint, url string, html string"


def pages(spark, n=300, size=900):
    return spark.createDataFrame([(i, f"http://h/{i % 3}", f"<p>{i}</p>" * (size // 10)) for i in range(n)], PAGES)


def test_records_and_offsets(spark):
    rows = wf.index(with_clashing_columns(pages(spark, 25)), pages_per_archive=10).orderBy("page_id").collect()
    at = {}
    for r in rows:
        body = f"<p>{r.page_id}</p>" * 90
        record = (f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://h/{r.page_id % 3}\r\n"
                  f"Content-Length: {len(body)}\r\n\r\n{body}\r\n\r\n")
        assert (r.archive, r.offset) == (r.page_id // 10, at.get(r.archive, 0))
        assert (r.length, r.digest) == (len(record), hashlib.sha256(record.encode()).hexdigest())
        at[r.archive] = r.offset + r.length


def reference_root(records):
    def node(pairs):
        return hashlib.sha256(",".join(f"{k}:{v}" for k, v in sorted(pairs)).encode()).hexdigest()

    def level(pairs, width):
        groups = {}
        for k, v in pairs:
            groups.setdefault(k // width, []).append((k, v))
        return [(k, node(own)) for k, own in groups.items()]

    return node(level(level(records, wf.LEAF_BYTES), wf.FANOUT))


def test_roots_equal_a_tree_by_hand(spark):
    index = wf.index(pages(spark, 300, 20_000), pages_per_archive=150)
    roots = {r.archive: r.hash for r in wf.tree(index)[0].collect()}
    own = {}
    for r in index.collect():
        own.setdefault(r.archive, []).append((r.offset, r.digest))
    assert max(o for o, _ in own[0]) > wf.LEAF_BYTES * wf.FANOUT
    assert roots == {a: reference_root(v) for a, v in own.items()}


def test_audit_finds_exactly_the_damage(spark):
    good = wf.index(pages(spark), pages_per_archive=60)
    bad = good.where("page_id NOT IN (7, 200)").withColumn(
        "digest", F.when(F.col("page_id").isin(61, 62, 250), F.lit("0" * 64)).otherwise(F.col("digest")))
    extra = good.where("page_id = 90").select("archive", "page_id", (F.col("offset") + 3).alias("offset"), "length",
                                              "digest")
    lost = bad.unionByName(extra).where("archive <> 2")
    archives, damages = wf.audit(good, lost)
    differ = {r.archive for r in archives.where("NOT root_a <=> root_b").collect()}
    assert differ == {0, 1, 2, 3, 4}
    got = {(r.page_id, r.kind) for r in damages.collect()}
    want = {(7, "missing"), (200, "missing"), (61, "altered"), (62, "altered"), (250, "altered"), (90, "extra")}
    assert got == want | {(i, "missing") for i in range(120, 180)}
    archives, damages = wf.audit(good, good)
    assert archives.where("root_a = root_b").count() == 5 and damages.count() == 0


def test_nulls_repeats_and_empty(spark):
    odd = spark.createDataFrame([(None, None, None), (None, "u", "x"), (1, None, "a"), (1, None, "a"), (2, "u", None),
                                 (3, "u", "é🙂" * 50_000)], PAGES)
    index = wf.index(odd)
    assert index.count() == 6 and index.where("archive < 0").count() == 2
    archives, damages = wf.audit(index, index.where("page_id <> 3"))
    assert {(r.page_id, r.kind) for r in damages.collect()} == {(3, "missing"), (None, "missing")}
    archives, damages = wf.audit(index.limit(0), index.limit(0))
    assert archives.count() == 0 and damages.count() == 0


@pytest.mark.parametrize("side", ["a", "b"])
def test_one_replica_is_empty(spark, side):
    good = wf.index(pages(spark, 5))
    archives, damages = wf.audit(*((good, good.limit(0)) if side == "a" else (good.limit(0), good)))
    assert archives.count() == 1
    assert {r.kind for r in damages.collect()} == {"missing" if side == "a" else "extra"}
    assert damages.count() == 5


def test_files_round_trip_and_damage_on_disk(spark, tmp_path):
    some = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i} é</p>\r\n\r\nend" * 40) for i in range(50)], PAGES)
    for replica in ("a", "b"):
        wf.write_warc(some, str(tmp_path / replica), pages_per_archive=20)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # records cross the splits
    try:
        a = wf.read_warc(spark, str(tmp_path / "a"))
        assert sorted((r.url, r.body) for r in a.collect()) == sorted((r.url, r.html) for r in some.collect())
        want = {(r.offset, r.length, r.digest) for r in wf.index(some, pages_per_archive=20).collect()}
        assert {(r.offset, r.length, r.digest) for r in a.collect()} == want
        (file,) = (tmp_path / "b" / "archive=1").glob("part-*")
        data = bytearray(file.read_bytes())
        hurt = next(r for r in a.collect() if r.url == "http://h/31")
        data[hurt.offset + hurt.length - 20] ^= 1
        file.write_bytes(bytes(data))
        (tmp_path / "b" / "archive=1" / f".{file.name}.crc").unlink(missing_ok=True)
        archives, damages = wf.audit(wf.file_index(a), wf.file_index(wf.read_warc(spark, str(tmp_path / "b"))))
        assert [r.archive for r in archives.where("root_a <> root_b").collect()] == ["archive=1"]
        assert [(r.offset, r.length, r.kind) for r in damages.collect()] == [(hurt.offset, hurt.length, "altered")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_query_on_repeated_and_null_ids(spark, tmp_path):
    rows = [(i, "u", f"<p>{i}</p>" * 20) for i in (1, 2, 5, 11, 13, 20)]  # 5 altered, 11 lost, 13 with one added
    rows += [(20, "u", "<p>other</p>")] * 3 + [(5, "v", "<p>5</p>")] * 2 + [(11, "v", "<p>11</p>")]
    rows += [(None, "u", f"<p>none {i}</p>") for i in range(4)] + [(None, "u", "<p>none 0</p>"), (None, None, None)]
    spark.createDataFrame(rows, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    out = QUERIES["op1_merkle_fixity"](spark, str(tmp_path)).collect()
    got = sorted((r.page_id, r.kind) for r in out if r.kind)
    assert got == [(5, "altered")] * 3 + [(11, "missing")] * 2 + [(13, "extra")]
    assert all((r.root_a == r.root_b) == (r.archive < 0) for r in out)
    assert sum(r.archive < 0 for r in out) == len({r.archive for r in out if r.archive < 0}) > 0
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    columns = ", ".join(f'"{c}"' for c in out[0].asDict())
    want = con.execute(f"SELECT {columns} FROM ({ORACLE['op1_merkle_fixity']})").fetchall()
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


def test_written_pages_without_an_id_lie_where_the_index_says(spark, tmp_path):
    some = spark.createDataFrame([(None, "u", f"<p>{i}</p>") for i in range(40)] + [(3, "u", "b"), (3, "u", "a")], PAGES)
    wf.write_warc(some, str(tmp_path / "a"))
    got = {(r.archive, r.offset, r.digest) for r in wf.read_warc(spark, str(tmp_path / "a")).collect()}
    assert got == {(f"archive={r.archive}", r.offset, r.digest) for r in wf.index(some).collect()}
    assert len({a for a, _, _ in got}) > 20
