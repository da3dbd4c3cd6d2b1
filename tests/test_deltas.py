"""Views refreshed from new rows alone."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from claimloom.params import Params
from claimloom.plans import deltas, views
from claimloom.sources.testdata import Tables

PATH, P = "/root/testdata/sf0.001", Params()
FULL = {"mv_processing_summary": views.processing_summary, "v_high_volume_stats": views.high_volume_stats, "mv_validation_summary": views.validation_summary}


def rows(df):
    names = sorted(df.columns)
    return sorted(str(tuple(r[c] for c in names)) for r in df.collect())


@pytest.mark.parametrize("name", sorted(deltas.MERGEABLE))
def test_refreshes_in_any_cut_equal_the_view(spark, name):
    t, (source, since) = Tables(spark, PATH), deltas.SOURCES[name]
    view, folder = deltas.MERGEABLE[name], f"/tmp/checkpoints/{name}-{uuid.uuid4().hex}"
    for part in range(3):
        view.refresh(folder, part, source(deltas.with_rows(t, lambda k, part=part: k % 3 == part), P))
    view.refresh(folder, 2, source(deltas.with_rows(t, lambda k: k % 3 == 2), P))  # run again: replaced, not added
    want = rows(FULL[name](t, P))
    assert rows(view.result(spark, folder, since(P))) == want and want
    small = view.compact(spark, folder)
    assert rows(view.result(spark, small, since(P))) == want
    view.refresh(small, 1, source(deltas.with_rows(t, lambda k: F.lit(False)), P))  # no new rows
    assert rows(view.result(spark, small, since(P))) == want


def test_a_refresh_reads_new_rows_only(spark, tmp_path, monkeypatch):
    """The files that a refresh reads are those of the new rows; what it kept before isn't opened."""
    view = deltas.MERGEABLE["mv_validation_summary"]
    t = Tables(spark, PATH)
    t.validation_results.where("result_id % 100 = 7").write.parquet(f"{tmp_path}/new")
    view.refresh(f"{tmp_path}/view", 0, t.validation_results.where("result_id % 100 <> 7"))
    read, opened = type(spark.read).parquet, []
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *paths: opened.extend(paths) or read(self, *paths))
    view.refresh(f"{tmp_path}/view", 1, spark.read.parquet(f"{tmp_path}/new"))
    assert opened == [f"{tmp_path}/new"]
    monkeypatch.undo()
    assert rows(view.result(spark, f"{tmp_path}/view", deltas.SOURCES["mv_validation_summary"][1](P))) == rows(views.validation_summary(t, P))
