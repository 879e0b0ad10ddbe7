"""Versions of a stored table: one of two writers is refused, and readers see whole versions."""

import pytest

from noticeloom.sources.versions import Conflict, VersionedTable


def _rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "`a b` long")


def _read(table, version=None):
    return sorted(r[0] for r in table.read(version).collect())


def test_one_of_two_writers_is_refused(spark, tmp_path):
    table, other = (VersionedTable(spark, f"file://{tmp_path}/t") for _ in range(2))
    assert table.version() == 0
    with pytest.raises(ValueError):
        table.read()
    assert table.commit(_rows(spark, 1), 0) == 1
    base = other.version()
    assert table.commit(_rows(spark, 1, 2), base) == 2
    with pytest.raises(Conflict):
        other.commit(_rows(spark, 9), base)
    assert _read(table) == _read(other) == [1, 2] and _read(table, 1) == [1]
    assert other.commit(_rows(spark, 9), other.version()) == 3 and _read(table) == [9]


def test_a_writer_that_comes_second_at_the_last_moment(spark, tmp_path, monkeypatch):
    first, second = (VersionedTable(spark, f"file://{tmp_path}/t") for _ in range(2))
    first.commit(_rows(spark, 1), 0)
    write = type(_rows(spark)).write.fget

    def meanwhile(df):  # the other commits after the base was looked at
        monkeypatch.undo()
        first.commit(_rows(spark, 2), 1)
        return write(df)

    rows = _rows(spark, 3)
    monkeypatch.setattr(type(rows), "write", property(meanwhile))
    with pytest.raises(Conflict):
        second.commit(rows, 1)
    assert _read(first) == [2] and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("rows-")]) == 2


def test_what_died_is_never_seen(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t")
    table.commit(_rows(spark, 1), 0)
    _rows(spark, 7).write.parquet(f"{tmp_path}/t/rows-dead")
    assert _read(table) == [1]
    (tmp_path / "t" / "_versions" / "000000000002").write_text('{"folder": "rows-de')  # its file is half written
    assert table.version() == 1 and _read(table) == [1]
