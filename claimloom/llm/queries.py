"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table
from .hard_negatives import mine_hard_negatives
from .langid import identify_languages, learn
from .lexical import search_documents
from .licenses import scan_licenses
from .matroska import media_digests
from .mixing import mix_sources, with_sizes
from .ngram_join import ngram_jaccard_classes
from .pieces import encode_pieces
from .quality import apply_quality_rules, learn_rules
from .repeats import cut_repeats
from .secrets import scan_secrets
from .token_counts import count_tokens, edit_trees, token_trees
from .toxicity import score_toxicity


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify_languages(docs, learn(docs, train_rows=3_000))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's piece ids, decoded again and held against the text."""
    encoded = encode_pieces(table(spark, sf_dir, "documents"))
    return encoded.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), "pieces", "round_trip")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_classes(table(spark, sf_dir, "documents"), percent=75, width=5)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"), repo_col="doc_id", owner_col="source", shared_owners=3)


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = checkpointed(with_sizes(table(spark, sf_dir, "documents")))
    mixed = mix_sources(sized, weights=(1, 2, 3), most=3)
    position = F.when(F.col("passes") > 0, F.round(F.element_at("due", 1), 9))
    rows = mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "passes", position.alias("position"))
    return rows.orderBy("position", "doc_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = learn_rules(docs, table(spark, sf_dir, "labels"))
    return apply_quality_rules(docs, rules)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


#: Personal data that the edits of op10 mask: mail addresses, network addresses, long numbers. No match begins inside a
#: run that an earlier start has read, so the search is linear in the text.
PERSONAL = r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.]++|(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}|(?<![0-9])[0-9]{6,}+"


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after edits: a source tag in front, and masks for personal data."""
    trees = token_trees(table(spark, sf_dir, "documents"), carry=["source"])
    trees = trees.withColumn("row", F.struct(F.col("row.source").alias("source"), count_tokens().alias("n_tokens")))
    tag = F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"), F.concat(F.lit("["), F.coalesce("row.source", F.lit("unknown")), F.lit("] ")).alias("put"))
    edited = edit_trees(trees, F.array(tag), find=PERSONAL, put="[MASKED]")
    return edited.select("doc_id", "row.n_tokens", count_tokens().alias("n_tokens_edited"), "n_recounted", "n_edits")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row whose vec_id is divisible by 7 has the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label, positives=5, negatives=10, low_percent=30, high_percent=90, scale=256)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cut_repeats(table(spark, sf_dir, "documents"), length=200)
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def secret_scans_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op4 that SQL can express."""
    return op4_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def quality_rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that SQL can express."""
    return op6_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def license_scans_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that SQL can express."""
    return op8_license_scans(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def media_columns_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9 that SQL can express."""
    return op9_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_secret_scans": op4_secret_scans,
    "op5_mixing_sources": op5_mixing_sources,
    "op6_quality_rules": op6_quality_rules,
    "op7_toxicity": op7_toxicity,
    "op8_license_scans": op8_license_scans,
    "op9_media_columns": op9_media_columns,
    "op10_token_counts": op10_token_counts,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_lexical_search": op12_lexical_search,
    "op13_suffix_array_dedup": op13_suffix_array_dedup,
    "secret_scans_base": secret_scans_base,
    "quality_rules_base": quality_rules_base,
    "license_scans_base": license_scans_base,
    "media_columns_base": media_columns_base,
}

ORACLE: dict[str, str] = {
    "op5_mixing_sources": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM sized GROUP BY source),
caps AS (SELECT *, (rank % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS words_left,
    (sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weight_left FROM caps),
flagged AS (SELECT *, cap * weight_left <= words_left * weight AS capped FROM levels),
facts AS (
  SELECT source, rank, source_size, CASE WHEN capped THEN cap::DOUBLE
    ELSE (max(CASE WHEN NOT capped THEN words_left::DOUBLE / weight_left END) OVER ()) * weight END AS target FROM flagged),
placed AS (
  SELECT s.doc_id, s.size, f.rank, f.source_size, f.target, floor(f.target)::BIGINT AS words,
    (sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(s.doc_id::VARCHAR, '')), s.doc_id NULLS FIRST, s.size ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS start
  FROM sized s JOIN facts f ON s.source IS NOT DISTINCT FROM f.source),
split AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS whole FROM placed),
parts AS (SELECT *, greatest(0, least(words - whole * source_size - start, size)) AS part FROM split),
taken AS (
  SELECT *, whole * size + part AS taken, CASE WHEN size > 0 THEN whole + (part > 0)::BIGINT ELSE 0 END AS passes,
    (start + 0.5::DOUBLE * (CASE WHEN whole > 0 THEN size ELSE part END)) / CASE WHEN target > 0 THEN target END AS demand FROM parts),
due AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 2.0::DOUBLE * demand / (1.5::DOUBLE + sqrt(2.25::DOUBLE + (-2.0)::DOUBLE * demand))
    WHEN 1 THEN 2.0::DOUBLE * demand / (1.0::DOUBLE + sqrt(1.0::DOUBLE + 0.0::DOUBLE * demand))
    ELSE 2.0::DOUBLE * demand / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2.0::DOUBLE * demand)) END AS moment FROM taken)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken, passes::INTEGER AS passes,
  CASE WHEN passes > 0 THEN round(least(greatest(moment, 0.0::DOUBLE), 1.0::DOUBLE), 9) END AS position FROM due
""",
    "op11_hard_negatives": r"""
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM whole a JOIN whole b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
met AS (
  SELECT p.anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM met WHERE rank <= 10
""",
    "op12_lexical_search": r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
sized AS (SELECT r, doc_id, len(terms)::BIGINT AS n, terms FROM docs WHERE len(terms) > 0),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM sized),
postings AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM sized) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM postings, whole GROUP BY term),
items AS (
  SELECT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS i, * FROM benchmark)),
scored AS (
  SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))))::BIGINT AS score
  FROM items JOIN weights USING (term) JOIN postings USING (term), whole GROUP BY ALL),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
""",
    "op13_suffix_array_dedup": r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
strings AS (SELECT r, p, md5(b[p + 1:p + 200]) AS k FROM (SELECT r, b, unnest(range(0, octet_length(b) - 199)) AS p FROM docs WHERE octet_length(b) >= 200)),
again AS (SELECT r, p FROM strings WHERE k IN (SELECT k FROM strings GROUP BY k HAVING count(*) > 1)),
marked AS (SELECT r, p, CASE WHEN p - 200 <= lag(p) OVER w THEN 0 ELSE 1 END AS fresh FROM again WINDOW w AS (PARTITION BY r ORDER BY p)),
numbered AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS run FROM marked),
runs AS (SELECT r, run, min(p) AS a, max(p) + 200 AS e FROM numbered GROUP BY r, run),
gaps AS (SELECT r, a, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) AS since FROM runs),
cut AS (SELECT r, count(*)::BIGINT AS n_spans, sum(e - a)::BIGINT AS n_removed, max(e) AS last, string_agg(hex(b[since + 1:a]), '' ORDER BY a) AS head FROM gaps JOIN docs USING (r) GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '')) || b[coalesce(last, 0) + 1:]) AS kept_sha256
FROM docs LEFT JOIN cut USING (r)
""",
    "secret_scans_base": r"""
SELECT doc_id,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda v: length(v) >= 6))::BIGINT AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 20))::BIGINT AS n_access,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda v: length(v) >= 24))::BIGINT AS n_hex
FROM documents
""",
    "quality_rules_base": r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS (SELECT r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS place FROM docs),
runs AS (SELECT r, place, word AS a, lead(word) OVER w AS b, lead(word, 2) OVER w AS c FROM found WINDOW w AS (PARTITION BY r ORDER BY place)),
twice AS (SELECT r, place FROM (SELECT r, place, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM runs WHERE c IS NOT NULL) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT place + step)::BIGINT AS n FROM twice, (VALUES (0), (1), (2)) s(step) GROUP BY r),
counted AS (
  SELECT doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM docs LEFT JOIN covered USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
""",
    "license_scans_base": r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
found AS (SELECT r, unnest(words) AS a, generate_subscripts(words, 1) - 1 AS place FROM docs),
ahead AS (SELECT r, place, a, lead(a) OVER w AS b, lead(a, 2) OVER w AS c, lead(a, 3) OVER w AS d FROM found WINDOW w AS (PARTITION BY r ORDER BY place)),
places AS (
  SELECT r, place, CASE WHEN a = 'gnu' AND b = 'general' AND c = 'public' AND d = 'license' THEN 'gpl' WHEN a = 'apache' AND b = 'license' THEN 'apache' WHEN a = 'cc' AND b = 'by' THEN 'cc-by' WHEN a = 'mit' AND b = 'license' THEN 'mit' END AS label FROM ahead),
each AS (SELECT r, count(*) AS n, min(place) AS first, max(place) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places WHERE label IS NOT NULL GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first::BIGINT AS first_word, last::BIGINT AS last_word, coalesce(labels, '') AS base_labels FROM docs LEFT JOIN each USING (r)
""",
    "media_columns_base": r"""
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS bytes FROM documents),
sized AS (SELECT *, octet_length(bytes)::BIGINT AS n_bytes FROM docs),
padded AS (SELECT *, greatest(1, (n_bytes + 575) // 576) * 576 AS payload_bytes FROM sized)
SELECT doc_id, n_bytes, payload_bytes::BIGINT AS payload_bytes, sha256(bytes || repeat('\xFF'::BLOB, payload_bytes - n_bytes)) AS payload_sha256 FROM padded
""",
}
