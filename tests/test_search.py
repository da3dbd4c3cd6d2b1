"""Stems, and an index held against plain Python."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from claimloom.functions.stems import STOP, stem
from claimloom.operators import search

# Words and their stems.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
    "falling": "fall", "happy": "happi", "sky": "sky", "relational": "relat", "building": "build", "machinery": "machineri", "furniture": "furnitur", "household": "household", "automobile": "automobil", "adjustment": "adjust",
    "replacement": "replac", "gas": "gas", "bus": "bus", "is": "is", "fac001": "fac001", "payments": "payment", "claims": "claim", "rating": "rate", "controll": "control",
}


def test_stems(spark):
    rows = spark.createDataFrame([(w,) for w in STEMS], "w string")
    assert {r.w: r.s for r in rows.select("w", stem(F.col("w")).alias("s")).collect()} == STEMS


def texts(n):
    return [(k, ["The Buildings of FAC001", "building claims, paid claims", "Household & furniture", None, "", "a claim of FAC001 building"][k % 6] if k % 7 else f"word{k} claim") for k in [*range(n), 65_535, 65_536, 200_000]]


def plain(rows):
    out = {}
    for k, text in rows:
        for w in set(re.split("[^a-z0-9]+", (text or "").lower())) - {"", *STOP}:
            out.setdefault(STEMS.get(w, {"buildings": "build", "claim": "claim", "paid": "paid", "building": "build"}.get(w, w)), set()).add(k)
    return out


def held(index):
    out = {}
    for r in search.keys(index.read()).collect():
        out.setdefault(r.term, set()).add(r.key)
    return out


def test_index_search_and_refresh(spark):
    rows = texts(60)
    frame = lambda r: spark.createDataFrame(r, "k long, text string")
    index = search.SearchIndex(spark, f"/tmp/checkpoints/search-{uuid.uuid4().hex}")
    index.build(frame(rows), "k", ["text"])
    assert held(index) == plain(rows)
    assert {r.key for r in index.search("Building", "fac001").collect()} == plain(rows)["build"] & plain(rows)["fac001"]
    assert index.search("nowhere", "claims").count() == 0
    files = lambda: {(r[0], str(r[1])) for r in index.read().select("_metadata.file_path", "_metadata.file_modification_time").distinct().collect()}
    before = files()
    changed = [(k, "new text" if k in (3, 65_535) else text) for k, text in rows]
    index.refresh(frame(changed), frame([(3, ""), (65_535, "")]), "k", ["text"])
    assert held(index) == plain(changed)
    assert {f for f in before if "block=0" not in f[0]} <= files() and not {f for f in before if "block=0" in f[0]} & files()
    plan = index.search("building", "claim")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan


def test_lists_are_made_where_a_blocks_claims_are(spark):
    found = search.postings(spark.createDataFrame(texts(60), "k long, text string"), "k", ["text"])
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange ") == 1 and "hashpartitioning(block" in plan and "Join" not in plan
