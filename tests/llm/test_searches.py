"""Hard negatives, ranked search and repeated strings, held against brute force and SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import hard_negatives, lexical, repeats
from claimloom.llm.hard_negatives import mine_hard_negatives
from claimloom.llm.lexical import search_documents
from claimloom.llm.queries import ORACLE, QUERIES
from claimloom.llm.repeats import cut_repeats
from claimloom.llm.suffixes import permuted_prefixes, suffix_array


def plain(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_lexical_search", "op13_suffix_array_dedup"])
def test_queries_equal_the_sql(spark, path, name):
    rows = QUERIES[name](spark, path)
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    found = con.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(rows.columns)
    want = plain(found.fetchall())
    assert plain(rows.select(names).collect()) == want
    assert want


# -- hard negatives --------------------------------------------------------------------------


def mined(rows, k=5, m=10):
    """rows: (id, vector, label). The rule itself, over all pairs."""
    kept = [(i, [math.floor(256.0 * x) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for a, (i, v, y) in enumerate(kept):
        if i is None or i % 100:
            continue
        scored = [(sum(p * q for p, q in zip(v, w, strict=False)), j, z) for b, (j, w, z) in enumerate(kept) if b != a]
        for s, j, _ in sorted((r for r in scored if r[2] == y), key=order)[:k]:
            fits = sorted((r for r in scored if r[2] != y and 30 * s <= 100 * r[0] <= 90 * s), key=order)[:m]
            out += [(i, j, n + 1, t, s, r) for n, (r, t, _) in enumerate(fits)]
    return plain(out)


VECTORS = "vec_id long, embedding array<float>, label int, norm string, `a.b` string, row string, anchor string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "q") for r in rows], VECTORS)


def is_hundredth():
    return F.col("vec_id") % 100 == 0


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(0, 1, 6).astype(np.float32).tolist(), k % 3) for k in range(300)]
    rows += [(300, None, 1), (None, [0.5] * 6, 1), (400, [float("nan")] * 6, 2), (401, [float("inf"), *[0.0] * 5], 2), (402, [None, *[1.0] * 5], 0), (403, [1.0] * 6, None)]
    rows += [(500, [0.0] * 6, 1), (600, [], 1), (700, [2.0, 1.0], 0), (800, [4e3] * 6, 2), (100, rows[100][1], rows[100][2]), (200, rows[7][1], 1)]
    rows += [(900 + k, rows[100][1], 2) for k in range(40)]  # ties
    assert plain(mine_hard_negatives(vectors(spark, rows), is_hundredth()).collect()) == mined(rows)
    assert mine_hard_negatives(vectors(spark, []), is_hundredth()).count() == 0


def test_pruning_changes_no_row(spark, monkeypatch):
    """Norms that differ by far, small buckets, several groups of anchors."""
    monkeypatch.setattr(hard_negatives, "BUCKET_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "GROUP_ANCHORS", 4)
    rng = np.random.default_rng(5)
    rows = [(k, (rng.normal(0.3, 1, 8) * 10.0 ** (k % 4 - 2)).astype(np.float32).tolist(), int(rng.integers(0, 3))) for k in range(1500)]
    assert plain(mine_hard_negatives(vectors(spark, rows), is_hundredth()).collect()) == mined(rows)


def test_a_lane_leaves_short_buckets_unread(monkeypatch):
    met = []
    products = hard_negatives._products
    monkeypatch.setattr(hard_negatives, "_products", lambda a, b: met.append(len(a)) or products(a, b))
    one = np.ones((1, 4), np.int64)
    lane = hard_negatives._Lane([(np.array([0]), np.array([0]), np.array([1]), one * 10, one[:, :1] * 100, one[:, :1] * 300)], 2, False)
    for top in (20.0, 10.0, 4.9, 1.0):
        big = np.repeat(one * int(top / 2), 3, axis=0)
        lane.meet(top, np.arange(3), np.arange(3), np.array([2, 2, 1]), big)
    assert len(met) == 2 and lane.result().num_rows == 2  # |a| = 20, so a norm below 5 can't reach 100


# -- ranked search ---------------------------------------------------------------------------


def ranked(docs, items, k=10):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))

    held = [(i, c, sum(c.values())) for i, c in ((i, Counter(terms(t))) for i, t in docs) if c]
    n_docs, total, df = len(held), sum(n for *_, n in held), Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in held:
            m = 100 - 75 + (75 * n * n_docs) // total
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w, r in Counter(terms(text)).items() if w in c)
            scored += [(-score, i is None, i or 0)] * (score > 0)
        out += [(item, j + 1, None if none else i, -s) for j, (s, none, i) in enumerate(sorted(scored)[:k])]
    return plain(out)


ITEMS = [(1, "the quick Brown fox"), (2, None), (3, ""), (4, "漢 ñandú 😀"), (None, "owls owls moon"), (5, "nowhere"), (6, "one two one"), (6, "one two one"), (7, "x" * 300_000), (8, "12345")]


def test_odd_documents_and_items(spark, odd, empty, monkeypatch):
    items = spark.createDataFrame([(*r, "x", "y") for r in ITEMS], "item_id long, text string, score string, `a.b` string")
    docs = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    want = ranked(docs, ITEMS)
    assert plain(search_documents(odd, items).collect()) == want and want
    assert search_documents(empty, items).count() == search_documents(odd, items.limit(0)).count() == 0
    monkeypatch.setattr(lexical, "SMALL", 3)  # many item terms: joined by shuffle
    assert plain(search_documents(odd, items).collect()) == want


def test_a_search_reads_the_buckets_of_an_index(spark, odd):
    index = lexical.build_index(odd)
    assert index.documents == 10 and index.postings.where("term = 'moon'").select("bucket").distinct().count() == 1
    items = lexical.item_terms(spark.createDataFrame([(1, "Moon")], "item long, text string"))
    assert [r.doc_id for r in lexical.search(index, items).collect()] == [t[2] for t in ranked([tuple(r) for r in odd.select("doc_id", "text").collect()], [(1, "moon")])]


# -- suffix arrays and repeated strings ------------------------------------------------------


def test_suffix_arrays_equal_sorted_suffixes():
    rng = np.random.default_rng(0)
    for trial in range(150):
        text = rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(0, 80)))
        text = np.append(np.tile(text[:9], 6) if trial % 3 == 0 else text, 0).astype(np.uint16)
        order = suffix_array(text)
        assert order.tolist() == sorted(range(len(text)), key=lambda k: text[k:].tolist())
        prefixes = permuted_prefixes(text.astype(np.uint8), order)
        for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
            shared = next((e for e in range(len(text)) if max(a, b) + e >= len(text) or text[a + e] != text[b + e]), 0)
            assert prefixes[b] == shared


def cut(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[a : a + length] for _, t in texts for a in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for a in range(len(t) - length + 1):
            if seen[t[a : a + length]] > 1:
                gone[a : a + length] = True
        turns = np.flatnonzero(np.diff(gone.astype(int), prepend=0))
        out.append((i, len(t), int(gone.sum()), len(turns) // 2, bytes(b for b, g in zip(t, gone, strict=False) if not g)))
    return plain(out)


def removed(docs, length):
    return plain(tuple(r) for r in cut_repeats(docs, length).select("doc_id", "n_bytes", "n_removed", F.size("spans"), "kept").collect())


def fixture(spark, seed=1):
    """Prose with copies, shared passages, repeats inside a text, one symbol, short periods, characters of several bytes."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdéü漢 ") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = prose(60)
    rows = [(k, prose(rng.randint(0, 90))) for k in range(40)]
    rows += [(40 + k, prose(12) + shared[rng.randint(0, 40) :] + prose(12)) for k in range(25)]
    rows += [(70, shared), (71, shared), (70, shared), (None, shared + shared), (72, "x" * 20_000), (73, "ab" * 3_000 + "c" + "ab" * 40), (74, "abc" * 33), (75, prose(500)), (76, None), (77, "")]
    return rows, spark.createDataFrame([(*r, "p", "q", "s") for r in rows], "doc_id long, text string, row string, `a.b` string, hash string")


@pytest.mark.parametrize("length", [200, 40, 7, 1])
def test_repeats_equal_brute_force(spark, length):
    rows, docs = fixture(spark)
    rows, docs = (rows, docs) if length > 7 else (rows[:50], docs.limit(50))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert removed(docs, length) == cut(rows, length)


def test_anchors_that_outgrow_a_shard_are_dealt_by_string(spark, monkeypatch):
    rows, docs = fixture(spark, 2)
    rows += [(100 + k, f"{k} wide boilerplate that all pages share, {k * k} and then their own text {k * 7919} " * 2) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(repeats, "ANCHOR_BYTES", 300)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 500)
    monkeypatch.setattr(repeats, "SLICE_BYTES", 700)
    assert removed(docs, 40) == cut(rows, 40)


def test_repeats_of_odd_rows(odd, empty):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    small = [(i, t) for i, t in rows if len(t or "") < 300_000]
    got = removed(odd, 200)
    assert [r for r in got if r[1] != 300_000] == cut(small, 200)
    assert [r[1:] for r in got if r[1] == 300_000] == [(300_000, 300_000, 1, b"")] * 2
    assert cut_repeats(empty).count() == 0
