"""The paged source: every record once, up to the short page, as a table and as a stream over a restart."""

import pytest

from noticeloom.sources import paged


def _store(path, api, page, records):
    (path / f"api={api}" / f"page={page}").mkdir(parents=True)
    (path / f"api={api}" / f"page={page}" / "part-0.txt").write_text("".join(f"{r}\n" for r in records))


@pytest.fixture
def source(spark):
    paged.register(spark)
    return spark


@pytest.mark.parametrize("count,readers", [(0, 8), (7, 8), (10, 3), (95, 4), (30, 50)])
def test_all_pages_up_to_the_short_one(source, tmp_path, count, readers):
    for page in range(count // 10 + 1):
        _store(tmp_path, "a", page + 1, range(10 * page, min(count, 10 * page + 10)))
    _store(tmp_path, "b", 1, ["x"])
    got = source.read.format("paged").option("path", f"file://{tmp_path}").option("api", "a, b, none").option("pagesize", 10).option("readers", readers).load()
    rows = sorted((r["api"], r["page"], r["place"], r["value"]) for r in got.collect())
    assert rows == sorted([("a", i // 10 + 1, i % 10, str(i)) for i in range(count)] + [("b", 1, 0, "x")])


def test_a_stream_goes_on_with_the_next_page(source, tmp_path):
    def run():
        stream = source.readStream.format("paged").option("path", f"file://{tmp_path}/in").option("api", "a").option("pagesize", 3).load()
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()
        return sorted(r["value"] for r in source.read.parquet(f"{tmp_path}/out").collect())

    _store(tmp_path / "in", "a", 1, "abc")
    _store(tmp_path / "in", "a", 2, "def")
    assert run() == list("abcdef")
    _store(tmp_path / "in", "a", 3, "g")
    assert run() == list("abcdefg") and run() == list("abcdefg")


def test_exported_csv(spark, tmp_path):
    from noticeloom.sources import files

    rows = spark.createDataFrame([("1", 'a "q", b', "two\nlines"), ("", " ", None), ("2", None, "é")], "id string, `a b` string, c string")
    files.export_csv(rows.coalesce(1), f"{tmp_path}/csv")
    raw = b"".join(p.read_bytes() for p in (tmp_path / "csv").glob("part-*"))
    assert raw.decode() == '﻿id,a b,c\r\n1,"a ""q"", b","two\nlines"\r\n, ,\r\n2,,é\r\n'
    assert sorted(tuple(r) for r in files.read_csv(spark, f"{tmp_path}/csv").collect()) == [("1", 'a "q", b', "two\nlines"), ("2", "", "é")]
