"""Tables of a database, held in the Derby that Spark carries: ranges, pushed filters, batches, inserts that can be repeated."""

from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F

from claimloom.sources import jdbc
from claimloom.sources.testdata import Tables

TYPES = {"claim_key": "BIGINT", "claim_id": "VARCHAR(32)", "facility_id": "VARCHAR(16)", "total_charge": "DECIMAL(12,2)"}


@pytest.fixture
def db():
    return jdbc.Database(f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "org.apache.derby.jdbc.EmbeddedDriver")


@pytest.fixture(scope="module")
def claims(spark):
    return Tables(spark, "/root/testdata/sf0.001").claims.select(*TYPES).na.fill("", ["facility_id"])  # Derby's VARCHAR takes no nulls from Spark


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_four_ranges_and_a_pushed_filter(spark, db, claims):
    db.write(claims, "claims", types=TYPES, partitions=3, batch=100)
    back = db.read(spark, "claims", key="claim_key", partitions=4)
    assert back.rdd.getNumPartitions() == 4
    assert rows_of(back.select(*TYPES)) == rows_of(claims)
    some = back.where("total_charge > 1000 and facility_id = 'FAC007'").select("claim_id")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "*GreaterThan(total_charge,1000" in plan and "*EqualTo(" in plan and "ReadSchema: struct<claim_id:string>" in plan
    assert rows_of(some) == rows_of(claims.where("total_charge > 1000 and facility_id = 'FAC007'").select("claim_id"))


def test_ranges_are_about_equal_where_keys_are_not(spark, db):
    keys = [*range(900), *random.Random(1).sample(range(10**9), 100), -5]
    df = spark.createDataFrame([(k, "x") for k in keys] + [(None, "none")] * 7, "k long, v string")
    db.write(df, "t", types={"k": "BIGINT", "v": "VARCHAR(8)"})
    back = db.read(spark, "t", key="k", partitions=4)
    assert back.count() == len(keys) + 7
    parts = [n for _, n in back.groupBy(F.spark_partition_id()).count().collect()]
    assert len(parts) == 4 and max(parts) <= 1.2 * len(keys) / 4 + 7
    assert sum(parts) == len(keys) + 7 and back.where("k is null").count() == 7
    db.write(df.where("k is null"), "t", mode="overwrite")
    assert db.read(spark, "t", key="k").count() == 7  # no key at all
    db.write(df.limit(0), "t", mode="overwrite")
    assert db.read(spark, "t", key="k").count() == 0 and db.read(spark, "t").count() == 0


@pytest.mark.parametrize("counts, parts", [([(0, 1)], 4), ([(0, 5), (1, 5), (2, 5), (3, 5)], 4), ([(0, 100), (1, 1), (9, 1)], 3), ([(k, k % 3) for k in range(200)], 7)])
def test_bounds_cut_into_few_parts(counts, parts):
    cuts = jdbc.bounds(counts, parts)
    assert len(cuts) < parts and cuts == sorted(set(cuts))
    edges = [float("-inf"), *cuts, float("inf")]
    sizes = [sum(n for b, n in counts if low <= b < high) for low, high in zip(edges, edges[1:])]
    assert sum(sizes) == sum(n for _, n in counts)
    assert max(sizes) <= sum(sizes) / parts + max(n for _, n in counts)


def test_an_insert_can_be_repeated(spark, db, claims):
    db.write(claims.where("claim_key % 2 = 0"), "claims", types=TYPES)
    both = claims.unionByName(claims).unionByName(claims.limit(3).withColumn("claim_key", F.lit(None).cast("long")))
    assert db.insert_absent(both, "claims", "claim_key", TYPES) == claims.where("claim_key % 2 <> 0").count()
    assert db.insert_absent(both, "claims", "claim_key", TYPES) == 0
    assert rows_of(db.read(spark, "claims").select(*TYPES)) == rows_of(claims)
    broken = claims.limit(2).withColumn("facility_id", F.lit("far too long for its column"))
    with pytest.raises(Exception):
        db.insert_absent(broken.withColumn("claim_key", -F.col("claim_key")), "claims", "claim_key", TYPES | {"facility_id": "VARCHAR(64)"})
    assert db.read(spark, "claims").count() == claims.count()
    assert db.read(spark, "SYS.SYSTABLES").where("TABLENAME like 'CLAIMS_%'").count() == 0  # nothing stays beside the table


def test_reads_go_to_the_replica_and_names_are_plain(spark, db):
    other = jdbc.Database(f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", db.driver)
    df = spark.createDataFrame([(1,)], "k int")
    db.write(df, "t")
    other.write(df.union(df), "t")
    split = jdbc.Database(db.url, db.driver, replica=other.url)
    assert split.read(spark, "t").count() == 2 and split.read(spark, "t", read_only=False).count() == 1
    for name in ("t; drop table t", "a b", "", "x.y.z"):
        with pytest.raises(ValueError):
            db.read(spark, name)
