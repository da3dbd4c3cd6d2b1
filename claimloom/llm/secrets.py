"""Secret scans with corpus-wide ownership frequency.

Candidates are found in every text by fixed patterns. The digest of each value
is counted over the corpus by distinct repositories and distinct owners: a
value that several owners share, or that is spread over very many repositories,
is a copied example; one that stays with its owner and looks random is a live
credential.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .common import Batches, checkpointed, column, join_hot, tidy

# Fixed patterns of the base kinds, in their listed order. The value is group 2 of assign, else the whole match.
ASSIGN = r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of [A-Z0-9] that fails the 20 characters fails from every later start too
HEX = r"[0-9a-f]{24,}"  # likewise
# Fixed patterns that the method adds. None begins inside a run that an earlier start has read, so each is linear in the text.
MORE = {
    "forge": r"\bgh[pousr]_[A-Za-z0-9]{20,}",
    "chat": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{4,}+",
    "pem": r"-----BEGIN (?:[A-Z]++ )*?PRIVATE KEY-----",
    "url": r"(?<![A-Za-z0-9+.-])[a-z][a-z0-9+.-]++://[^\s:/@]++:[^\s:/@]{3,}+@",
}
_HINTS = {"forge": "gh", "chat": "xox", "jwt": "eyJ", "pem": "-----BEGIN", "url": "://"}
KINDS = ["assign", "access", "hex", *MORE]
_assign, _access, _hex = re.compile(ASSIGN), re.compile(ACCESS), re.compile(HEX)
_more = {k: re.compile(p) for k, p in MORE.items()}
_KEYWORDS = ("password", "passwd", "secret", "token", "api")

Span = tuple[str, int, int, str]
SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("value", StringType()), StructField("bits", DoubleType())]))


def find_spans(text: str) -> list[Span]:
    """(kind, start, end, value) by start, then kind as listed; code points, end exclusive."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [("assign", m.start(), m.end(), m[2]) for m in _assign.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in _access.finditer(text)]
    out += [("hex", m.start(), m.end(), m[0]) for m in _hex.finditer(text)]
    for kind, pattern in _more.items():
        if _HINTS[kind] in text:
            out += [(kind, m.start(), m.end(), m[0]) for m in pattern.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def randomness(value: str) -> float:
    """Entropy of the characters in bits; 0 for an empty value."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def _scan(batches: Batches) -> Batches:
    for batch in batches:
        out = []
        for text in batch.column("_sec_text").to_pylist():
            out.append([{"kind": k, "start": a, "end": b, "value": hashlib.sha256(v.encode("utf-8", "replace")).hexdigest(), "bits": randomness(v)} for k, a, b, v in find_spans(text or "")])
        kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n != "_sec_text"]
        spans = pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("bits", pa.float64())])))
        yield pa.record_batch([*[c for _, c in kept], spans], [*[n for n, _ in kept], "sec_spans"])


def spans_of(docs: DataFrame, text_col: str = "text", carry: list[Column] | None = None) -> DataFrame:
    """The columns in carry, then sec_spans: array of (kind, start, end, digest of the value, bits)."""
    rows = docs.select(*(carry or []), column(text_col).alias("_sec_text"))
    return rows.mapInArrow(tidy(_scan), StructType([*rows.schema.fields[:-1], StructField("sec_spans", SPANS)]))


def ownership(found: DataFrame) -> DataFrame:
    """Distinct repositories and owners of each value, and its rows; found has repo, owner and sec_spans."""
    each = found.where(F.size("sec_spans") > 0).select("repo", "owner", F.explode("sec_spans").alias("s"))
    return each.groupBy(F.col("s.value").alias("value")).agg(
        F.count_distinct(F.coalesce(F.col("repo").cast("string"), F.lit("-"))).alias("repos"),
        F.count_distinct(F.coalesce(F.col("owner").cast("string"), F.lit("-"))).alias("owners"),
        F.count("*").alias("rows"),
    )


def _example(shared_owners: int, shared_repos: int) -> Column:
    return (F.col("owners") >= shared_owners) | (F.col("repos") >= shared_repos)


def _joined(spans: str, base: bool = False) -> Column:
    kept = F.filter(spans, lambda s: s["kind"].isin("assign", "access", "hex")) if base else F.col(spans)
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("sec_spans", lambda s: s["kind"] == kind)).cast("long")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", shared_owners: int = 3, live_bits: float = 2.5, shared_repos: int = 1000) -> DataFrame:
    """Spans of every text, and which of them are live or copied examples.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live,
    n_example, live_spans, most_repos. A value is an example when shared_owners
    owners or shared_repos repositories or more have it, live when fewer have it
    and its characters carry live_bits of entropy or more. most_repos is the
    largest number of repositories that have a value of the text, 0 without one. Null texts count as empty and have no spans; null
    repositories and owners count as one each. Repeated rows give repeated rows
    but one ownership. An empty table gives an empty table.
    """
    found = checkpointed(spans_of(docs, text_col, [column(id_col).alias("doc_id"), column(repo_col).alias("repo"), column(owner_col).alias("owner")]))
    found = found.withColumn("row", F.monotonically_increasing_id())
    owners = ownership(found)
    each = found.where(F.size("sec_spans") > 0).select("row", F.explode("sec_spans").alias("s")).select("row", "s", F.col("s.value").alias("value"))
    judged = join_hot(each, owners, "value", "row").select("row", F.struct(F.col("s.start").alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), F.col("s.kind")).alias("place"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind"), _example(shared_owners, shared_repos).alias("example"), (F.col("s.bits") >= live_bits).alias("random"), F.col("repos")).alias("t"))
    verdicts = judged.groupBy("row").agg(F.array_sort(F.collect_list("t")).alias("t"))
    out = found.join(verdicts, "row", "left").withColumn("t", F.coalesce("t", F.array().cast(verdicts.schema["t"].dataType)))
    live = F.filter("t", lambda s: ~s["example"] & s["random"])
    return out.withColumn("live", live).select(
        "doc_id",
        _count("assign").alias("n_assign"),
        _count("access").alias("n_access"),
        _count("hex").alias("n_hex"),
        F.sha2(_joined("sec_spans", base=True).cast("binary"), 256).alias("base_sha256"),
        _joined("sec_spans").alias("spans"),
        F.size("live").cast("long").alias("n_live"),
        F.size(F.filter("t", lambda s: s["example"])).cast("long").alias("n_example"),
        _joined("live").alias("live_spans"),
        F.coalesce(F.array_max("t.repos"), F.lit(0)).cast("long").alias("most_repos"),
    )


def _redact(mask: str, batches: Batches) -> Batches:
    for batch in batches:
        out = []
        for text, examples in zip(batch.column("_sec_text").to_pylist(), batch.column("_sec_keep").to_pylist(), strict=True):
            if text is not None:
                known, pieces, at = set(examples or ()), [], 0
                for kind, start, end, value in find_spans(text):
                    if known and hashlib.sha256(value.encode("utf-8", "replace")).hexdigest() in known:
                        continue
                    if start >= at:
                        pieces += [text[at:start], mask.format(kind=kind)]
                    at = max(at, end)
                text = "".join(pieces) + text[at:] if pieces else text
            out.append(text)
        yield pa.record_batch([batch.column("_row"), pa.array(out, pa.string())], ["_row", "_sec_new"])


def redact_secrets(docs: DataFrame, text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", shared_owners: int = 3, mask: str = "[{kind}]", broadcast_rows: int = 50_000, shared_repos: int = 1000) -> DataFrame:
    """The same rows and columns, each secret span in the text masked by its kind.

    Values that shared_owners owners or shared_repos repositories or more have
    are copied examples and stay; all others go, random or not (what scan_secrets
    calls live is a subset: of it, one knows that the value is random). Null texts stay null; rows are neither dropped nor added. The
    table of texts with examples is broadcast up to broadcast_rows rows and
    joined by shuffle beyond.
    """
    digest = F.sha2(column(text_col).cast("binary"), 256)
    found = spans_of(docs, text_col, [column(repo_col).alias("repo"), column(owner_col).alias("owner"), digest.alias("digest")])
    found = checkpointed(found.where(F.size("sec_spans") > 0))
    each = found.select("digest", F.explode("sec_spans.value").alias("value")).distinct()
    judged = join_hot(each, ownership(found), "value", "digest").where(_example(shared_owners, shared_repos))
    keep = checkpointed(judged.groupBy("digest").agg(F.collect_set("value").alias("_sec_keep")).withColumnRenamed("digest", "_sec_digest"))
    small = keep.limit(broadcast_rows + 1).count() <= broadcast_rows
    rows = docs.select(F.struct(*[column(c).alias(c) for c in docs.columns if c != text_col]).alias("_row"), column(text_col).alias("_sec_text"), digest.alias("_sec_digest"))
    rows = rows.join(F.broadcast(keep) if small else keep, "_sec_digest", "left").select("_row", "_sec_text", "_sec_keep")
    done = rows.mapInArrow(tidy(_redact, mask), StructType([rows.schema["_row"], StructField("_sec_new", StringType())]))
    return done.select(*[(F.col("_sec_new") if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns])
