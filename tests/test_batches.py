"""Appended batches are there once and whole, or not at all."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import export

SCHEMA = "id long, s string"


def rows(spark, folder):
    return sorted(tuple(r) for r in export.read_batches(spark, folder, SCHEMA).collect())


def batch(spark, lo, hi):
    return spark.range(lo, hi).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"))


def test_batches_are_there_once(spark, tmp_path):
    folder = str(tmp_path)
    assert rows(spark, folder) == [] and export.clear_attempts(spark, folder) == 0
    assert export.append_batch(batch(spark, 0, 10), folder, "day-1")
    assert not export.append_batch(batch(spark, 0, 10), folder, "day-1")
    assert export.append_batch(batch(spark, 10, 20).repartition(4), folder, "day-2")
    export.append_json_lines(batch(spark, 20, 25), folder, "day-3")
    assert [r[0] for r in rows(spark, folder)] == list(range(25)) and rows(spark, folder)[0][1] is None
    with pytest.raises(ValueError, match="batch"):
        export.append_batch(batch(spark, 0, 1), folder, "../x")


def test_a_job_killed_before_its_commit_leaves_nothing(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    export.append_batch(batch(spark, 0, 5), folder, "a")
    with monkeypatch.context() as m:
        m.setattr(export, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            export.append_batch(batch(spark, 5, 9), folder, "b")
    assert len(rows(spark, folder)) == 5 and len(list((tmp_path / "batches").iterdir())) == 2
    assert export.append_batch(batch(spark, 5, 9), folder, "b")
    assert [r[0] for r in rows(spark, folder)] == list(range(9))
    assert export.clear_attempts(spark, folder) == 1 and len(rows(spark, folder)) == 9


def test_a_job_that_fails_while_it_writes_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path)
    broken = spark.range(8).repartition(4).select("id", F.when(F.col("id") == 5, F.raise_error(F.lit("lost"))).otherwise("x").cast("string").alias("s"))
    with pytest.raises(Exception, match="lost"):
        export.append_batch(broken, folder, "a")
    assert rows(spark, folder) == []
    assert export.append_batch(batch(spark, 0, 8), folder, "a") and len(rows(spark, folder)) == 8


def test_of_two_attempts_one_is_committed(spark, tmp_path):
    folder = str(tmp_path)
    for name in ("x", "y"):
        batch(spark, 0, 4).write.json(f"{folder}/batches/{name}")
    commit = lambda data: export._commit(spark, f"{folder}/commits", f"{folder}/commits/a.json", f'{{"batch": "a", "data": "batches/{data}"}}')
    assert [commit("x"), commit("y")] == [True, False]
    assert len(rows(spark, folder)) == 4 and [r.data for r in export.batches(spark, folder).collect()] == ["batches/x"]
