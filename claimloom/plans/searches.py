"""Queries of the search index over claims, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stems import STOP, stem_sql
from ..operators import search
from ..session import shared_folder
from ..sources.testdata import Tables
from .oracle import sql
from .queries import query

FIELDS = ("claim_id", "account", "facility_id", "payer_name", "facility_name")
_TERMS = f""" named AS (SELECT claim_key, lower(concat_ws(' ', claim_id, account, c.facility_id, payer_name, facility_name)) AS text FROM claims c LEFT JOIN financial_classes k ON k.financial_class_id = c.financial_class_id LEFT JOIN payers y ON y.payer_id = k.payer_id LEFT JOIN facilities f ON f.facility_id = c.facility_id),
words AS (SELECT DISTINCT claim_key, unnest(regexp_split_to_array(text, '[^a-z0-9]+')) AS word FROM named),
asked AS (SELECT DISTINCT word FROM words WHERE word <> '' AND word NOT IN ({", ".join(f"'{w}'" for w in STOP)})),
{stem_sql("asked")},
held AS (SELECT DISTINCT term, claim_key FROM words JOIN stemmed USING (word))"""


def searchable(t: Tables) -> DataFrame:
    """Claims with the fields that are searched."""
    payer = t.financial_classes.join(t.payers, "payer_id").select("financial_class_id", "payer_name")
    x = t.claims.select("claim_key", "claim_id", "account", "facility_id", "financial_class_id")
    return x.join(payer, "financial_class_id", "left").join(t.facilities.select("facility_id", "facility_name"), "facility_id", "left").select("claim_key", *FIELDS)


def index_of(t: Tables) -> search.SearchIndex:
    index = search.SearchIndex(t.spark, f"{shared_folder(t.spark)}/search-{uuid.uuid4().hex}")
    index.build(searchable(t), "claim_key", FIELDS)
    return index


query("search_postings", sql(f"""SELECT term, claim_key // {search.BLOCK} AS block, count(*) AS n, min(claim_key % {search.BLOCK})::BIGINT AS first, max(claim_key % {search.BLOCK})::BIGINT AS last, sum(claim_key % {search.BLOCK})::BIGINT AS total FROM held GROUP BY 1, 2""", _TERMS))(
    lambda t: search.places(index_of(t).read()).groupBy("term", "block").agg(F.count("*").alias("n"), F.min("place").alias("first"), F.max("place").alias("last"), F.sum("place").alias("total")))
query("search_two_words", sql("SELECT claim_key FROM held WHERE term = 'build' INTERSECT SELECT claim_key FROM held WHERE term = 'fac001'", _TERMS))(
    lambda t: index_of(t).search("Buildings", "FAC001").select(F.col("key").alias("claim_key")))
