"""The data source of numbered pages: which pages are read, and streams of them."""

import json
import shutil

import pytest

from gleanery.sources import paged


def write(folder, page, items):
    (folder / f"page={page}").mkdir(parents=True)
    (folder / f"page={page}" / "part-0.txt").write_text(json.dumps(items))


@pytest.fixture
def pages(spark, tmp_path):
    paged.register(spark)
    for p in range(7):
        write(tmp_path, p, [{"id": p * 10 + i, "tags": ["é", str(i)], "at": {"x": i / 2}} for i in range(10 if p < 6 else 4)])
    return tmp_path


def load(spark, path, **options):
    return spark.read.format("paged_json").schema("id long, tags array<string>, at struct<x:double>, missing string, page int, row long").option("path", str(path)).options(pageSize=10, **options).load()


@pytest.mark.parametrize(("offset", "limit"), [(0, 10), (15, 20), (39, 1), (10, 10), (60, 100), (64, 5), (200, 5), (5, 0), (13, None), (0, None)])
@pytest.mark.parametrize("together", [1, 3])
def test_rows_asked_for(spark, pages, offset, limit, together):
    got = load(spark, pages, offset=offset, pagesPerPartition=together, **({} if limit is None else {"limit": limit})).collect()
    expected = list(range(64))[offset : None if limit is None else offset + limit]
    assert sorted(r["row"] for r in got) == sorted(r["id"] for r in got) == expected
    assert all(r["page"] == r["row"] // 10 and r["tags"] == ["é", str(r["id"] % 10)] and r["at"]["x"] == r["id"] % 10 / 2 and r["missing"] is None for r in got)


def test_only_pages_asked_for_are_read(spark, pages):
    df = load(spark, pages, offset=15, limit=20)
    assert df.rdd.getNumPartitions() == 3
    for p in (0, 4, 5, 6):
        (pages / f"page={p}" / "part-0.txt").write_text("no JSON")
    assert df.count() == 20
    with pytest.raises(Exception, match="Expecting value"):
        load(spark, pages, offset=15, limit=30).count()


def test_a_stream_reads_each_page_once(spark, pages, tmp_path_factory):
    work = tmp_path_factory.mktemp("stream")
    last = pages / "page=6"
    shutil.move(last, work / "held")

    def run():
        stream = spark.readStream.format("paged_json").schema("id long, page int").option("path", str(pages)).options(pageSize=10).load()
        query = stream.writeStream.format("parquet").option("path", str(work / "out")).option("checkpointLocation", str(work / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted(r["id"] for r in spark.read.parquet(str(work / "out")).collect())

    assert run() == list(range(60)) == run()
    shutil.move(work / "held", last)
    assert run() == list(range(64))
