"""The export killed at every step and run again; months as folders."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from claimloom.plans.exports import export, store_of
from claimloom.sources.store import ClaimStore
from claimloom.sources.testdata import Tables

PATH = "/root/testdata/sf0.001"


class Killed(Exception):
    pass


def tables_of(store):
    out = {}
    for name in ("production", "failed", "status", "manifest", "batches"):
        rows = store.read(name)
        columns = sorted(rows.columns)
        out[name] = sorted(str(tuple(r[c] for c in columns)) for r in rows.collect())
    return out


@pytest.fixture(scope="module")
def whole(spark):
    store = store_of(Tables(spark, PATH))
    counts = export(Tables(spark, PATH), store, 1, size=200).first()
    return tables_of(store), counts


@pytest.mark.parametrize("step", ["production", "failed", "status", "manifest"])
def test_a_killed_export_runs_again(spark, whole, monkeypatch, step):
    """Killed once the named table has been written (the manifest: just before), then run again with other pending claims added."""
    t = Tables(spark, PATH)
    store = store_of(t)
    write, schema_of, seen = ClaimStore.write, type(spark.read).schema, []
    if step in ("production", "failed"):
        def stop(self, rows, name, *by):
            write(self, rows, name, *by)
            if name == step:
                raise Killed
        monkeypatch.setattr(ClaimStore, "write", stop)
    else:  # status and manifest are written by plain writers; the counts' read stands between them
        def stop(self, schema):
            if "is_exported" in str(schema):
                seen.append(1)
                raise Killed
            return schema_of(self, schema)
        monkeypatch.setattr(type(spark.read), "schema", stop)
    with pytest.raises(Killed):
        export(t, store, 1, size=200)
    monkeypatch.undo()
    assert store.read("manifest") is None and (store.current().where("status = 'VALIDATION_FAILED_RULES'").count() == 0)
    store.write(t.claims.where("claim_key % 5 = 0").withColumns({"claim_id": F.concat(F.lit("late-"), "claim_id"), "created_date": F.lit("1970-01-01").cast("timestamp"), "service_month": F.lit("2030-01")}), "claims", "service_month")
    counts = export(t, store, 1, size=200).first()
    assert (counts.dequeued, counts.exported, counts.failed) == (whole[1].dequeued, whole[1].exported, whole[1].failed)
    assert tables_of(store) == whole[0]


def test_batches_take_no_claim_twice(spark):
    t = Tables(spark, PATH)
    store = store_of(t)
    counts = [export(t, store, k, size=300).first() for k in (1, 2, 3)]
    assert sum(c.dequeued for c in counts) == min(900, t.claims.where("status = 'PENDING'").count())
    assert store.read("batches").groupBy("claim_id").count().where("count > 1").count() == 0
    empty = export(t, store_of(t), 1, facility_id="nowhere").first()
    assert (empty.dequeued, empty.exported, empty.failed) == (0, 0, 0)


def test_a_month_is_read_alone(spark):
    store = store_of(Tables(spark, PATH))
    plan = store.claims("1995-03", "1995-03").select("claim_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(service_month" in plan and "1995-03" in plan
    months = store.claims().select("service_month").distinct().where("service_month like '%-03'").withColumn("k", F.lit(1)).where("k = 1")
    spark.createDataFrame([("1995-03", "x")], "service_month string, why string").write.mode("overwrite").parquet(store.path("chosen"))
    joined = store.claims().join(spark.read.parquet(store.path("chosen")).where("why = 'x'"), "service_month")
    assert "dynamicpruning" in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == store.claims("1995-03", "1995-03").count() and months.count() > 1


def old():
    return (F.col("status") == "COMPLETED") & (F.col("processed_date") < F.lit("1996-01-01").cast("timestamp_ntz"))


def files_of(rows):
    return {(r[0], r[1]) for r in rows.select("_metadata.file_path", F.col("_metadata.file_modification_time").cast("string")).distinct().collect()}


def test_archiving_touches_only_its_months(spark, monkeypatch):
    t = Tables(spark, PATH)
    store = store_of(t)
    month = F.date_format("service_date", "yyyy-MM")
    store.write(store.read("claims").where("service_month = '1995-02'").withColumns({"status": F.lit("COMPLETED"), "processed_date": F.lit("1995-03-01").cast("timestamp_ntz")}).transform(lambda d: d.sparkSession.createDataFrame(d.collect(), d.schema)), "claims", "service_month")
    before = store.read("claims").collect()
    outside, moved = files_of(store.claims("1995-07")), files_of(store.claims("1995-02", "1995-02"))

    swap, calls = ClaimStore._swap, []
    def killed(self):
        calls.append(1)
        if len(calls) == 2:
            raise Killed
        swap(self)
    monkeypatch.setattr(ClaimStore, "_swap", killed)
    with pytest.raises(Killed):
        store.archive(old(), "1995-06")
    monkeypatch.undo()
    store.archive(old(), "1995-06")

    assert files_of(store.claims("1995-07")) == outside
    name = lambda files: {(f.rsplit("/", 1)[1], m) for f, m in files}
    assert moved and name(moved) == name(files_of(store.read("archive").where("service_month = '1995-02'")))  # a folder that was moved
    gone = {r.claim_id for r in before if r.status == "COMPLETED" and r.processed_date < datetime(1996, 1, 1) and r.service_date and f"{r.service_date:%Y-%m}" <= "1995-06"}
    assert {r.claim_id for r in store.read("archive").collect()} == gone
    assert {r.claim_id for r in store.read("claims").collect()} == {r.claim_id for r in before} - gone
    store.archive(old(), "1995-06")  # nothing is left to move
    assert store.read("archive").count() == len(gone)

    export(t, store, 1, size=20)
    export(t, store, 2, size=20)
    dropped = {r.what: r.dropped for r in store.retain("1995-03", 2).collect()}
    assert dropped == {"months": len({f"{r.service_date:%Y-%m}" for r in before if r.claim_id in gone and f"{r.service_date:%Y-%m}" < "1995-03"}), "batches": 1}
    assert [r.batch for r in store.read("manifest").collect()] == [2] and store.read("archive").where(month < "1995-03").count() == 0


def test_batches_read_lines_and_validate_once_each(spark, monkeypatch):
    from claimloom.plans import exports, queries
    from claimloom.sources.testdata import Tables

    calls, seen = [], queries.scoring.features
    monkeypatch.setattr(queries.scoring, "features", lambda *tables: calls.append(1) or seen(*tables))
    store = exports.batches(Tables(spark, "/root/testdata/sf0.001"))
    assert len(calls) == 1
    assert store.read("manifest").count() == 3 and store.exists("disposed") and not store._parts("disposed")
