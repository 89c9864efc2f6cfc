import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsloom.sources import sinks

D1, D2 = dt.date(2026, 8, 1), dt.date(2026, 8, 2)


@pytest.fixture()
def path(tmp_path):
    return str(tmp_path / "table")


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "date date, n int")


def kept(spark, path):
    return sorted((r.date, r.n) for r in spark.read.schema("date date, n int").parquet(path).collect())


def none(df):
    return df.select(F.lit("W").alias("severity"))


def test_only_the_dates_written_are_replaced(spark, path):
    sinks.gated_write(rows(spark, [(D1, 1), (D2, 2)]), none, path)
    sinks.gated_write(rows(spark, [(D2, 3)]), none, path)
    assert kept(spark, path) == [(D1, 1), (D2, 3)]


def test_a_failed_gate_leaves_nothing(spark, path):
    sinks.gated_write(rows(spark, [(D1, 1)]), none, path)
    with pytest.raises(ValueError):
        sinks.gated_write(rows(spark, [(D1, 9), (D2, 2)]), lambda df: df.where("n = 9").select(F.lit("E").alias("severity")), path)
    with pytest.raises(ZeroDivisionError):
        sinks.gated_write(rows(spark, [(D1, 8)]), lambda df: 1 / 0, path)
    assert kept(spark, path) == [(D1, 1)] and sinks.StagedDates(spark, path)._names("_staged") == []


def test_a_write_that_dies_before_its_commit_leaves_nothing(spark, path):
    sinks.gated_write(rows(spark, [(D1, 1)]), none, path)
    table = sinks.StagedDates(spark, path)
    table.stage(rows(spark, [(D1, 7), (D2, 7)]))  # the driver is lost here
    bad = rows(spark, [(D1, 7)]).withColumn("n", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        table.stage(bad)  # and here while tasks write
    assert kept(spark, path) == [(D1, 1)]
    assert table.recover() == [] and table._names("_staged") == [] and kept(spark, path) == [(D1, 1)]


def test_a_write_that_dies_while_dates_move_is_finished(spark, path, monkeypatch):
    sinks.gated_write(rows(spark, [(D1, 1), (D2, 1)]), none, path)
    moved = []
    publish = sinks.StagedDates._publish

    def dies(self, name):
        moved.append(name)
        date = self._names(f"_staged/{name}")[1]
        self.fs.delete(self._path(date), True)
        self.fs.rename(self._path(f"_staged/{name}/{date}"), self._path(date))
        raise KeyboardInterrupt

    monkeypatch.setattr(sinks.StagedDates, "_publish", dies)
    with pytest.raises(KeyboardInterrupt):
        sinks.gated_write(rows(spark, [(D1, 2), (D2, 2)]), none, path)
    monkeypatch.setattr(sinks.StagedDates, "_publish", publish)
    assert sinks.StagedDates(spark, path).recover() == moved
    assert kept(spark, path) == [(D1, 2), (D2, 2)]
