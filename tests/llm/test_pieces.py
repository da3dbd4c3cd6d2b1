from __future__ import annotations

import hashlib
import random

import pytest
import sentencepiece

from claimloom.llm.common import tokenizer_file
from claimloom.llm.pieces import Model, cut, decode_pieces, encode_pieces, settle

PATH = tokenizer_file("piece_bpe_32k.model")
ALPHABETS = ["the and ing tion   ", "abc", "aeiou xyz\n", "é漢▁ \tqb", "0123456789abcdef", "    a"]


@pytest.fixture(scope="module")
def both():
    return Model(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


def scan(m, text, chunk):
    chunks = list(cut(m.normal(text), chunk, 2 * m.longest))
    right = settle([m.transfer(w, a, b, k == 0, k == of - 1) for k, of, w, a, b in chunks])
    return [i for (k, of, w, a, b), x, y in zip(chunks, [0, *right[:-1]], right, strict=True) for i in m.backtrace(w, a, b, x, y, k == 0, k == of - 1)]


def test_equals_the_library(both):
    m, library = both
    rng = random.Random(3)
    for _ in range(600):
        text = "".join(rng.choice(rng.choice(ALPHABETS)) for _ in range(rng.choice([0, 1, 2, 5, 20, 100, 300])))
        ids = library.encode(text)
        assert m.encode(text) == ids
        assert m.decode(ids) == library.decode(ids)
        if text:
            assert scan(m, text, 40) == ids


def test_chunks_inside_one_giant_word(both):
    m, library = both
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghij0123") for _ in range(3000))
    assert scan(m, text, 64) == scan(m, text, 500) == library.encode(text)


def test_rows(spark, both, odd, empty):
    _, library = both
    got = sorted((str(r.doc_id), r.digest, tuple(r.pieces)) for r in encode_pieces(odd, giant=1000, chunk=700).collect())
    want = sorted((str(r.doc_id), hashlib.sha256((r.text or "").encode()).hexdigest(), tuple(library.encode(r.text or ""))) for r in odd.collect())
    assert got == want
    back = {r.digest: r.text for r in decode_pieces(encode_pieces(odd)).collect()}
    plain = [r.text or "" for r in odd.collect() if "▁" not in (r.text or "")]
    assert all(back[hashlib.sha256(t.encode()).hexdigest()] == t for t in plain)
    assert encode_pieces(empty).count() == 0


def test_one_path_stands(both):
    """Of all ways to cut a text into pieces just one has neighbours that all stand: the model's own."""
    m, library = both
    rng = random.Random(6)

    def paths(text, at, before):
        if at == len(text):
            return [[]]
        return [[p, *rest] for p in m.starting(text, at, len(text)) if m.follows(before, p) for rest in paths(text, p[1], p)]

    for _ in range(150):
        text = "".join(rng.choice("abcdeing é0▁") for _ in range(rng.randrange(1, 12)))
        found = paths(m.normal(text), 0, None)
        assert len(found) == 1 and m.ids(m.normal(text), found[0]) == library.encode(text)


def test_all_documents_go_through_chunks(spark, both, path):
    """With every text a giant of short chunks, the scan gives the public encoder's pieces for the whole table."""
    _, library = both
    docs = spark.read.parquet(f"{path}/documents.parquet").where("length(text) > 0")
    got = {r.doc_id: (tuple(r.pieces), r.round_trip) for r in encode_pieces(docs, giant=0, chunk=400).collect()}
    assert got == {r.doc_id: (tuple(library.encode(r.text)), True) for r in docs.collect()}


def test_clashing_names(spark):
    encoded = spark.createDataFrame([(1, [22172, 3186], "old"), (2, None, "old")], "id int, pieces array<int>, text string")
    got = decode_pieces(encoded)
    assert got.columns == ["id", "pieces", "text"] and [r.text is None for r in got.orderBy("id").collect()] == [False, True]
