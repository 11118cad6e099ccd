"""Intermediate tables and their removal."""

import os

import pytest

from assay.session import cut, lasting, passing, remove, scratch_dir


def folders(spark):
    top = scratch_dir(spark).removeprefix("file:")
    return set(os.listdir(top))


def test_passing_tables_go_and_lasting_ones_stay(spark):
    before = folders(spark)
    with passing(spark):
        a = cut(spark.range(5))
        with passing(spark):
            b = cut(a.selectExpr("id + 1 AS id"))
            c = lasting(b.selectExpr("id * 2 AS id"))
        assert len(folders(spark) - before) == 2  # a and c
        kept = lasting(c)
    assert sorted(r.id for r in kept.collect()) == [2, 4, 6, 8, 10]
    assert len(folders(spark) - before) == 1


def test_tables_go_after_an_error(spark):
    before = folders(spark)
    with pytest.raises(ZeroDivisionError), passing(spark):
        cut(spark.range(3))
        1 / 0
    assert folders(spark) == before


def test_only_the_shared_folder_is_touched(spark):
    with pytest.raises(ValueError):
        remove(spark, "/elsewhere")
