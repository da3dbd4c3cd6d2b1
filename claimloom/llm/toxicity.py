"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon of words and word beginnings is learned from labelled texts by a
likelihood-ratio test; features are its densities, its closeness to second-person
words, capitals, punctuation and obfuscation. Trees are fitted on the driver to
the features of a bounded sample and applied in Arrow batches.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import Batches, checkpointed, column, held_out, slices, spread, tidy, utf8

# Words that count as insults even without labels.
INSULTS = ["clown", "disgusting", "fool", "idiot", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless"]
# Second-person words of English, German, French and Spanish.
SECOND = ["du", "dein", "deine", "dich", "dir", "ihr", "euch", "te", "ti", "toi", "ton", "tu", "tus", "u", "ur", "usted", "vos", "votre", "vous", "you", "your", "yours", "yourself"]

_LETTER = [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]
_WORDS = bytes((b + 32 if 65 <= b <= 90 else b) if b in set(_LETTER) else 32 for b in range(256))
_LEET = bytes.maketrans(b"0134578@$!*", b"oieastbasii")
#: A run of letters, digits and marks that stand for letters, with single dots or dashes inside; plain words don't match. All
#: repeats are possessive and a run is entered at its start only, so that the search is linear in the text.
_RUN = re.compile(rb"(?<![a-z0-9@$!*])(?:[a-z]++(?=[0-9@$!*]|[._-][a-z0-9])|[@$])(?:[a-z0-9@$!*]|[._-](?=[a-z0-9]))*+")
_TRICK = re.compile(rb"[0-9@$!*._-][a-z]")
_HEAD = 5
FEATURES = 13


@dataclass
class Lexicon:
    weights: dict[bytes, float]  # a beginning of _HEAD bytes stands with a leading ^


def _terms(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def obfuscated(text: bytes) -> list[bytes]:
    """Whole runs of three characters or more in which a digit, mark, dot or dash stands before a letter."""
    return [run for run in _RUN.findall(text.lower()) if len(run) > 2 and _TRICK.search(run)]


def features(text: bytes, lexicon: Lexicon, second: frozenset[bytes] = frozenset(w.encode() for w in SECOND)) -> list[float]:
    terms = _terms(text)
    n = max(1, len(terms))
    weights = lexicon.weights
    counted = Counter(terms)
    hits = {w: c for w, c in counted.items() if w in weights}
    heads = {w: c for w, c in counted.items() if w not in hits and len(w) > _HEAD and b"^" + w[:_HEAD] in weights}
    near = 0
    if hits or heads:
        at = [k for k, w in enumerate(terms) if w in hits or w in heads]
        near = sum(not second.isdisjoint(terms[max(0, k - 4) : k + 5]) for k in at)
    odd = tricked = 0
    for found in obfuscated(text):
        odd += 1
        plain = found.translate(_LEET, b"._-")
        tricked += plain in weights and found not in weights
    tally = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = max(1, int(tally[65:91].sum() + tally[97:123].sum() + tally[128:].sum()))
    size = max(1, len(text))
    h, b = sum(hits.values()), sum(heads.values())
    return [
        h / n, b / n, np.log1p(h), np.log1p(b), near / n,
        sum(weights[w] * c for w, c in hits.items()) / n + sum(weights[b"^" + w[:_HEAD]] * c for w, c in heads.items()) / n,
        tricked / n, odd / n, float(tally[65:91].sum()) / letters, float(tally[33] + tally[63]) / size,
        float(tally[33:48].sum() + tally[58:65].sum() + tally[91:97].sum() + tally[123:127].sum()) / size, float(tally[48:58].sum()) / size, np.log1p(len(terms)),
    ]


def _matrix(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    raw, offsets = utf8(column)
    out = np.zeros((len(column), FEATURES))
    for a, b in slices(offsets, 1 << 20):
        for k in range(a, b):
            out[k] = features(raw[offsets[k] : offsets[k + 1]].tobytes(), lexicon)
    return out


def _term_counts(batches: Batches) -> Batches:
    total: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        raw, offsets = utf8(batch.column(0))
        data = raw.tobytes()
        for a, b, label in zip(offsets[:-1], offsets[1:], batch.column(1).to_pylist(), strict=True):
            own = set(_terms(data[a:b]))
            total[label].update(own | {b"^" + w[:_HEAD] for w in own if len(w) > _HEAD})
    both = list(total[0].keys() | total[1].keys())
    if both:
        yield pa.record_batch([pa.array(both, pa.binary()), pa.array([total[1][t] for t in both], pa.int64()), pa.array([total[0][t] for t in both], pa.int64())], ["term", "bad", "good"])


def _learn_lexicon(sample: DataFrame, most: int, least_gain: float) -> Lexicon:
    """Terms far more frequent in labelled texts: G-squared of at least least_gain, the `most` strongest."""
    rows = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = rows.get(1, 0), rows.get(0, 0)
    weights = {w.encode(): 3.0 for w in INSULTS}
    if bad and good:
        counts = sample.select("text", "label").mapInArrow(tidy(_term_counts), "term binary, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        share = (F.col("bad") + F.col("good")) / F.lit(float(bad + good))
        logs = lambda c, n: F.when(c > 0, c * F.log(c / (share * n))).otherwise(0.0)
        gain = 2 * (logs(F.col("bad"), float(bad)) + logs(F.col("good"), float(good)))
        odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
        strong = counts.select("term", gain.alias("gain"), odds.alias("odds")).where((F.col("gain") >= least_gain) & (F.col("odds") > 1.5))
        for r in strong.orderBy(F.desc("gain"), "term").limit(most).collect():
            weights[bytes(r["term"])] = float(r["odds"])
    return Lexicon(weights)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", train_rows: int = 12_000, lexicon_terms: int = 3_000, least_gain: float = 24.0, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """Learns from the labelled rows outside the held-out third.

    train_rows bounds the sample: that many labelled ids at most, in a fixed
    pseudo-random order, each with one of its texts (the smallest). lexicon_terms
    bounds the lexicon, least_gain is the G-squared that a term needs to enter it.
    """
    named = labels.select(column(id_col).alias("label_id"), column(label_col).cast("int").alias("label")).where("label_id is not null and label in (0, 1)")
    named = named.where(~held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("label").alias("label"))
    chosen = named.withColumn("place", spread(F.col("label_id"), "toxicity")).orderBy("place", "label_id").limit(train_rows)
    sample = docs.select(column(id_col).alias("label_id"), column(text_col).alias("text")).join(F.broadcast(chosen), "label_id").where("text is not null")
    sample = checkpointed(sample.groupBy("label_id", "label", "place").agg(F.min("text").alias("text")).select("text", "label", "place"))
    lexicon = _learn_lexicon(sample, lexicon_terms, least_gain)

    def measure(batches: Batches) -> Batches:
        for batch in batches:
            yield pa.record_batch([pa.array(list(_matrix(batch.column(0), lexicon)), pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "label", "place"])

    rows = sample.mapInArrow(tidy(measure), "x array<double>, label int, place long").orderBy("place").toPandas()
    x = np.stack(rows["x"]) if len(rows) else np.zeros((0, FEATURES))
    y, key = rows["label"].to_numpy(), rows["place"].to_numpy()
    return Scorer(lexicon, boosting.fit(x, y), *boosting.isotonic(boosting.folds(x, y, key), y))


@dataclass
class Scorer:
    """A trained model: texts to scores in 0..1."""

    lexicon: Lexicon
    trees: boosting.Boosted
    at: np.ndarray
    level: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        return np.clip(np.interp(self.trees.margin(_matrix(texts, self.lexicon)), self.at, self.level), 0.0, 1.0)


def _scores(scorer: Scorer, batches: Batches) -> Batches:
    for batch in batches:
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(scorer.score(batch.column(2)))], ["doc_id", "held_out", "score"])


def _below(scorer: Scorer, place: int, threshold: float, batches: Batches) -> Batches:
    for batch in batches:
        yield batch.filter(pa.array(scorer.score(batch.column(place)) < threshold))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """doc_id, held_out, score in 0..1 and predicted (score >= threshold) for each row.

    Null and empty texts are scored as texts without words. Labels, language,
    source and id never enter a score. Repeated rows get equal scores; other
    columns are ignored, so their names can't clash. Without usable labels the
    fixed insults still are the lexicon, but all scores are 0. An empty table
    gives an empty table.
    """
    scorer = train(docs, labels, id_col=id_col, text_col=text_col, **settings)
    rows = docs.select(column(id_col).alias("doc_id"), held_out(column(id_col)).alias("held_out"), column(text_col).alias("text"))
    scored = rows.mapInArrow(tidy(_scores, scorer), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows that score below the threshold, with all their columns and whatever these are called.

    A text goes to the worker once and back once, as the column that it is.
    Nulls, empty tables and absent labels are treated as score_toxicity does.
    """
    scorer = train(docs, labels, id_col=id_col, text_col=text_col, **settings)
    rows = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names with dots can't pass mapInArrow
    return rows.mapInArrow(tidy(_below, scorer, docs.columns.index(text_col), threshold), rows.schema).toDF(*docs.columns)
