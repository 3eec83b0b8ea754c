"""Shards with a manifest, blobs with descriptors, and stage tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from gleanery.sources import readers, sinks


def test_shards_are_read_whole_or_not_at_all(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code,n\n1,x\n2,y\n")
    (tmp_path / "b.csv").write_text("code,n\n3,z\n")
    pattern = str(tmp_path / "*.csv")
    stated = spark.createDataFrame([tuple(r) for r in readers.manifest(spark, pattern).select("shard", "sha256").collect()], "shard string, sha256 string")
    read = lambda s=stated: sorted(r["code"] for r in readers.whole_shards(spark, pattern, "code", s).collect())
    assert read() == ["1", "2", "3"] and stated.count() == 2
    with pytest.raises(Exception, match="1 shards differ from the manifest, first: b.csv"):
        read(stated.where("shard = 'a.csv'"))
    with pytest.raises(Exception, match="first: c.csv"):
        read(stated.unionByName(spark.createDataFrame([("c.csv", "0")], "shard string, sha256 string")))
    (tmp_path / "b.csv").write_text("code,n\n4,z\n")
    with pytest.raises(Exception, match="first: b.csv"):
        read()
    (tmp_path / "b.csv").write_text("code,n\n2,z\n")
    with pytest.raises(Exception, match="1 keys stand more than once, first: 2"):
        read(readers.manifest(spark, pattern))


def test_blobs_are_verified_before_they_are_parsed(spark, tmp_path):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    (tmp_path / "one.bin").write_bytes(b"one")
    (tmp_path / "two.bin").write_bytes(b"two")
    row = lambda name, content, text="{}": (name, sha(content), text, sha(text.encode()))
    frame = lambda *rows: spark.createDataFrame(list(rows), "name string, sha256 string, descriptor string, descriptor_sha256 string")
    read = lambda *rows: {r["name"]: bytes(r["content"]) for r in readers.replayed(spark, str(tmp_path), frame(*rows)).collect()}
    assert read(row("one.bin", b"one")) == {"one.bin": b"one"} and read(row("one.bin", b"one"), row("two.bin", b"two", '{"k": "é"}')).keys() == {"one.bin", "two.bin"}
    with pytest.raises(Exception, match="1 blobs differ from their descriptors, first: two.bin"):
        read(row("one.bin", b"one"), row("two.bin", b"2"))
    with pytest.raises(Exception, match="1 descriptors differ from their hashes, first: one.bin"):
        read(("one.bin", sha(b"one"), "{}", sha(b"[]")))
    with pytest.raises(Exception, match="no blob for three.bin"):
        read(row("three.bin", b"3"))


def test_a_stage_table_lasts_as_long_as_its_block(spark):
    with sinks.stage_table(spark.range(5).withColumn("x", F.rand()), "staged_rows") as rows:
        assert sorted(rows.collect()) == sorted(spark.sql("SELECT * FROM staged_rows").collect()) and rows.count() == 5
    assert not spark.catalog.tableExists("staged_rows")
    with pytest.raises(ZeroDivisionError), sinks.stage_table(spark.range(1), "staged_rows"):
        raise ZeroDivisionError
    assert not spark.catalog.tableExists("staged_rows")
