from __future__ import annotations

from pathlib import Path

import pytest

from quarrymill.llm.common import bound_batches, drop_stages, shared_dir, stage, words_in


def test_stages_are_files_until_dropped(spark):
    drop_stages(spark)
    staged = stage(spark.range(5).selectExpr("id", "id % 2 = 0 AS even"), "numbers", by="even")
    assert staged.where("even").count() == 3
    folders = list(Path(shared_dir(spark).removeprefix("file:")).glob("numbers-*"))
    assert len(folders) == 1
    drop_stages(spark)
    assert not folders[0].exists()


def test_batches_are_bounded_and_stricter_bounds_stay(spark):
    bound_batches(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    bound_batches(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10"
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize(("text", "n"), [(None, 0), ("", 0), (" \t\n", 0), ("a", 1), (" a\u00a0b\x0bc ", 2)])
def test_words(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(words_in("t")).first()[0] == n
