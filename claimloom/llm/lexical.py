"""Ranked lexical search over term-bucketed postings.

The index is a table with a row for each document and distinct term, dealt by
the term's bucket and a slice of the documents: a term that a third of all
documents hold is spread over as many tasks as there are slices, and a search
reads only the buckets of its terms. Items join the postings on (bucket, term);
each match is scored in integers, scores are summed by item and document, and
row_number picks the best. Few item terms are broadcast (their count is
checked) to postings that were dealt by document first, so that the sums need
no second shuffle; many are joined by shuffle.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Batches, ship, shuffle_width, spread, tidy, utf8, written
from .words import LOWER

BUCKETS = 1024
#: Item terms up to this many rows are broadcast, and vocabularies up to this many words are sent to the tasks that cut texts.
SMALL = 200_000
_ROWS = 65_536
_POSTINGS = "term string, row long, doc_id long, tf long, n long"
#: A-Z lower-cased; 0-9, a-z and all bytes of other code points stay; the rest splits terms.
TERM_BYTES = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The maximal runs of ASCII letters, digits and code points beyond ASCII, A-Z lower-cased."""
    return text.translate(TERM_BYTES).split()


def _batch(terms: list[bytes], rows: list[int], ids: list[int | None], tf: list[int], n: list[int]) -> pa.RecordBatch:
    whole = [pa.array(x, pa.int64()) for x in (rows, ids, tf, n)]
    return pa.record_batch([pa.array(terms, pa.binary()).cast(pa.string()), *whole], ["term", "row", "doc_id", "tf", "n"])


def _postings(vocabulary: frozenset[bytes] | None, batches: Batches) -> Batches:
    """A row for each text and distinct term, and one without a term: how many texts have terms (tf), and all their terms (n)."""
    texts = total = 0
    columns: tuple[list, ...] = ([], [], [], [], [])
    for batch in batches:
        raw, offsets = utf8(batch.column(2))
        rows, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            found = terms_of(raw[a:b].tobytes())
            if not found:
                continue
            texts += 1
            total += len(found)
            counts = Counter(found if vocabulary is None else filter(vocabulary.__contains__, found))
            m = len(counts)
            for column, values in zip(columns, (counts.keys(), [rows[k]] * m, [ids[k]] * m, counts.values(), [len(found)] * m), strict=True):
                column.extend(values)
            if len(columns[0]) >= _ROWS:
                yield _batch(*columns)
                columns = ([], [], [], [], [])
    yield _batch(*columns)
    yield _batch([None], [None], [None], [texts], [total])


@dataclass
class LexicalIndex:
    """bucket, slice, term, row, doc_id, tf, n; the number of documents with a term, and of all their terms."""

    postings: DataFrame
    documents: int
    terms: int


def _bucket(term: Column) -> Column:
    return F.pmod(spread(term, "term"), F.lit(BUCKETS)).cast("int")


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", slices: int = 32) -> LexicalIndex:
    """Postings of whole texts, written to the shared folder by bucket.

    With a vocabulary (column `term`), only its terms get postings; the counts of
    documents and terms are over all texts all the same. Null texts have no term.
    Rows that repeat an id are documents of their own.
    """
    spark = docs.sparkSession
    ship(spark)
    wanted = None
    if vocabulary is not None and len(found := vocabulary.select("term").distinct().limit(SMALL + 1).collect()) <= SMALL:
        wanted = frozenset(r.term.encode() for r in found)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = rows.mapInArrow(tidy(_postings, wanted), _POSTINGS)
    if vocabulary is not None and wanted is None:
        kept = vocabulary.select("term").distinct()
        found = found.where("term is null").unionByName(found.join(kept, "term", "left_semi").select(found.columns))
    dealt = found.withColumns({"bucket": _bucket(F.col("term")), "slice": F.pmod(spread(F.col("row"), "slice"), F.lit(slices)).cast("int")})
    dealt = dealt.repartition(shuffle_width(spark), "bucket", "slice").sortWithinPartitions("bucket", "term", "row")
    postings = written(dealt, "postings")
    total = postings.where("term is null").agg(F.sum("tf"), F.sum("n")).first()
    return LexicalIndex(postings.where("term is not null"), int(total[0] or 0), int(total[1] or 0))


def _item_terms(batches: Batches) -> Batches:
    for batch in batches:
        items, terms, times = [], [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = Counter(terms_of((text or "").encode()))
            items += [item] * len(counts)
            terms += counts.keys()
            times += counts.values()
        yield pa.record_batch([pa.array(items, pa.int64()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], ["item", "term", "times"])


def item_terms(items: DataFrame, text_col: str = "text") -> DataFrame:
    """item, term, times: the distinct terms of each item (a long) and their repeats."""
    return items.select("item", F.col(f"`{text_col}`").cast("string")).mapInArrow(tidy(_item_terms), "item long, term string, times long")


def term_weights(index: LexicalIndex) -> DataFrame:
    """term, w: floor(1000 * ln((2N + 2) / (2df + 1)))."""
    df = index.postings.groupBy("term").agg(F.count("*").alias("df"))
    return df.select("term", F.floor(F.log((F.lit(2.0 * index.documents + 2)) / (2.0 * F.col("df") + 1)) * 1000.0).alias("w"))


def impact(index: LexicalIndex) -> Column:
    """A posting's part of a score besides its weight, in 64-bit integers; nothing is negative, so `div` rounds down."""
    m = f"(25L + (75L * n * {index.documents}L) div {max(1, index.terms)}L)"
    return F.expr(f"(1000000000L * tf) div (1000L * tf + 8L * {m})")


def search(index: LexicalIndex, terms: DataFrame, k: int = 10) -> DataFrame:
    """item, rank, doc_id, score of each item's k best documents with a score above 0; ties by ascending doc_id, null last."""
    spark = index.postings.sparkSession
    width = shuffle_width(spark)
    wanted = written(terms.join(term_weights(index), "term").select("item", F.col("term").alias("of"), _bucket(F.col("term")).alias("at"), (F.col("w") * F.col("times")).alias("weight")), "item-terms")
    hits = index.postings.select("bucket", "slice", "term", "row", "doc_id", impact(index).alias("impact"))
    if wanted.limit(SMALL + 1).count() <= SMALL:
        wanted = F.broadcast(wanted)
        matched = hits.repartition(width, "row").join(wanted, (F.col("bucket") == F.col("at")) & (F.col("term") == F.col("of")))
    else:  # each term's items go to all slices of its postings
        slices = (index.postings.agg(F.max("slice")).first()[0] or 0) + 1
        wanted = wanted.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        matched = hits.join(wanted, (F.col("bucket") == F.col("at")) & (F.col("slice") == F.col("part")) & (F.col("term") == F.col("of")))
    scored = matched.groupBy("row", "item").agg(F.sum(F.col("weight") * F.col("impact")).alias("score"), F.first("doc_id").alias("doc_id"))
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    ranked = scored.where("score > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("item", "rank", "doc_id", "score")


def search_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 10) -> DataFrame:
    """Ranks all documents for each item: item_id, rank, doc_id, score.

    Only terms of items get postings. Null and empty texts hold no term, and
    items without a term in any document have no row. Every row of items is an
    item of its own, also where ids repeat or are null, and so is every row of
    docs. Equal scores go by ascending doc_id, null last. Empty tables give an
    empty table.
    """
    ship(docs.sparkSession)
    named = written(items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text")), "items")
    terms = written(item_terms(named), "terms")
    index = build_index(docs, terms, id_col, text_col)
    found = search(index, terms, k)
    return found.join(named.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
