from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from claimloom.llm import ngram_join
from claimloom.llm.common import table
from claimloom.llm.components import components
from claimloom.llm.ngram_join import ngram_jaccard_classes
from claimloom.llm.words import words


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, percent=75):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    at = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            at[g].append(k)
    for k, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in at[g] if j > k).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(j)] = find(k)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            smallest[find(k)] = min(smallest.get(find(k), i), i)
    return sorted(((i, len(sets[k]), smallest.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def classes(df):
    return sorted((tuple(r) for r in ngram_jaccard_classes(df).collect()), key=str)


def test_documents_equal_brute_force(spark, path):
    docs = table(spark, path, "documents")
    assert classes(docs) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_odd_rows(odd, empty):
    assert classes(odd) == brute([tuple(r) for r in odd.select("doc_id", "text").collect()])
    assert classes(empty) == []


def test_families_of_edited_copies(spark):
    """Copies at all distances, chains that link only through others, a passage that all share."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(6):
        base = [word() for _ in range(rng.choice([8, 40, 120]))]
        for _ in range(40):
            own = list(base)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(len(own))] = word()
            base = own if rng.random() < 0.2 else base
            rows.append((len(rows), " ".join(own + (passage if rng.random() < 0.5 else []))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert classes(df) == brute(rows)


def test_words_of_rows():
    raw = np.frombuffer("Aa bb aa\tAA longerword aa".encode(), np.uint8)
    found = words(raw, np.array([0, 9, len(raw)]))
    h = found.hashes
    assert h[0] == h[2] == h[3] == h[5] and len(set(h.tolist())) == 3
    assert found.row.tolist() == [0, 0, 0, 1, 1, 1] and found.counts(2).tolist() == [3, 3]


def test_words_that_collide_under_polynomials(spark):
    """A Thue-Morse word and its complement have one polynomial hash modulo 2 ** 64, whatever its base."""
    one, two = ("".join("ab"[bin(k).count("1") % 2 ^ flip] for k in range(4096)) for flip in (0, 1))
    rest = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"{one} {one}"), (2, f"{two} {two}"), (3, f"{rest} {one} {rest[:20]}"), (4, f"{rest} {two} {rest[:20]}"), (5, one), (6, two), (7, one)]
    assert classes(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_a_passage_that_alone_links_nothing(spark):
    """All documents share 56 of their 72 shingles: every one meets every other in the same columns, and none links."""
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, f"{passage} " + " ".join(f"d{k}x{j}" for j in range(16))) for k in range(150)]
    rows += [(1000 + k, f"{passage} " + " ".join(f"d{k}x{j}" for j in range(15)) + " other") for k in range(3)]
    assert classes(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_batches_and_blocks_do_not_matter(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(30)))) for k in range(300)]
    for bits in (8, 13):
        out = [b for b in _incidence_of(rows, bits)]
        assert sum(len(b) for b in out) > 1
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert classes(df) == brute(rows)


def _incidence_of(rows, bits):
    ids = pd.Series([r[0] for r in rows], dtype="Int64")
    raw = np.frombuffer("".join(r[1] for r in rows).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])])
    sets, sizes = ngram_join.gram_sets(raw, offsets, 5)
    table_ = pa.Table.from_batches(ngram_join._one(7, ids, sets, sizes, bits))
    blocks = [ngram_join._shared(bits, table_.filter(pc.equal(table_["block"], b))) for b in set(table_["block"].to_pylist())]
    back = ngram_join._gather(75, bits, pa.concat_tables([b.cast(table_.schema) for b in blocks]))
    for n, s, g in zip(back["n_shingles"].to_pylist(), sets, back["grams"].to_pylist(), strict=True):
        assert n == len(s) and (g is None or set(np.frombuffer(g, np.uint64).tolist()) <= set(s.tolist()))
    return table_.to_batches()


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(50, 60), (60, 70), (70, 50), (7, 7), (99, 99), (None, 3)], "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 50: 50, 60: 50, 70: 50, 99: 99}
