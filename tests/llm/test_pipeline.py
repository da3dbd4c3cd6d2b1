from __future__ import annotations

import re
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import sentencepiece
from claimloom.llm.common import table, tokenizer_file, written
from claimloom.llm.queries import ORACLE
from claimloom.llm.secrets import find_spans
from claimloom.llm.toxicity import score_toxicity

from test_ngram_join import brute


def masked(rows, spans_of):
    """Plain Python: all spans but those whose value three sources or a thousand documents have."""
    owners, repos = defaultdict(set), defaultdict(set)
    for r in rows:
        for *_, value in spans_of(r.text or ""):
            owners[value].add(r.source)
            repos[value].add(r.doc_id)
    out = Counter()
    for r in rows:
        text, pieces, at = r.text, [], 0
        for kind, a, b, value in spans_of(r.text or ""):
            if len(owners[value]) < 3 and len(repos[value]) < 1000:
                pieces += [text[at:a], f"[{kind}]"] if a >= at else []
                at = max(at, b)
        out[r.doc_id, "".join(pieces) + text[at:] if pieces else text] += 1
    return out


def test_run_equals_plain_python(spark, tmp_path, monkeypatch):
    """Each stage of run() on what run() gave it: scores, brute-force classes, plain masks, SQL shares, the public encoder."""
    path, kept = "/root/testdata/sf0.001", []
    monkeypatch.setattr(corpus_pipeline, "written", lambda df, name: kept.append(written(df, name)) or kept[-1])
    final = corpus_pipeline.run(spark, path).collect()
    source = table(spark, path, "documents")
    assert [k.columns for k in kept] == [source.columns] * 4
    before = [df.collect() for df in (source, *kept)]

    scored = Counter(r.doc_id for r in score_toxicity(source, table(spark, path, "labels"), threshold=0.7).where("predicted = 0").collect())
    assert Counter(r.doc_id for r in before[1]) == scored

    component = {i: c for i, _, c in brute([(r.doc_id, r.text) for r in before[1]])}
    assert Counter(before[2]) == Counter(r for r in before[1] if component[r.doc_id] == r.doc_id)

    assert Counter((r.doc_id, r.text) for r in before[3]) == masked(before[2], find_spans)

    kept[2].write.parquet(f"{tmp_path}/documents.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    taken = {i: (t, p, at) for i, t, p, at in duckdb.sql(f"SELECT doc_id, taken, passes, position FROM ({ORACLE['op5_mixing_sources']})").fetchall()}
    text = {r.doc_id: r.text for r in before[3]}
    want = Counter()
    for i, (words, passes, _) in taken.items():
        own = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text[i] or "")
        whole = words // len(own) if own else 0
        want[i, text[i]] += whole
        if passes > whole:
            want[i, "".join(own[: words - whole * len(own)])] += 1
    assert Counter((r.doc_id, r.text) for r in before[4]) == +want
    first = {}
    for k, r in enumerate(before[4]):
        first.setdefault(r.doc_id, (taken[r.doc_id][2], k))
    assert [x for x, _ in sorted(first.values(), key=lambda x: x[1])] == sorted(x for x, _ in first.values())

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    assert Counter((r.doc_id, r.n_pieces, tuple(r.pieces), r.round_trip) for r in final) == Counter((r.doc_id, len(p), tuple(p), True) for r in before[4] for p in [library.encode(r.text or "")])


def test_repeated_rows_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (None, "x y z", "en", None, 5), (2, None, None, "s", None), (None, "A b c d e f", "en", "s", 11), (7, "x Y z", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, rows, "")
    assert Counter(r.doc_id for r in kept.collect()) == Counter({1: 1, 7: 1, 2: 1})
    assert corpus_pipeline.drop_near_copies(spark, rows.limit(0), "").count() == 0
    assert corpus_pipeline.mix(spark, rows.limit(0), "").count() == 0


def test_odd_rows_pass_every_stage(spark, odd):
    """Clashing names, names with dots, nulls: each stage keeps all columns and its own rule on them."""
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    labels.write.mode("overwrite").parquet("/tmp/checkpoints/odd-labels/labels.parquet")
    docs = odd.selectExpr("*", "1L as n_chars")
    kept = [written(corpus_pipeline.STAGES[0][1](spark, docs, "/tmp/checkpoints/odd-labels"), "odd-0")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[1:-1], 1):
        kept.append(written(stage(spark, kept[-1], ""), f"odd-{k}"))
    assert all(k.columns == docs.columns for k in kept)
    rows = [k.collect() for k in kept]
    source = docs.collect()
    assert len(rows[0]) == len(source)
    classes = defaultdict(list)
    for k, _, component in brute([(k, r.text) for k, r in enumerate(source)]):
        classes[component].append((source[k].doc_id is None, source[k].doc_id or 0, k))
    assert Counter(r.doc_id for r in rows[1]) == Counter(source[min(own)[2]].doc_id for own in classes.values())
    assert len(rows[2]) == len(rows[1]) and len(corpus_pipeline.encode(spark, kept[-1], "").collect()) == len(rows[3])
