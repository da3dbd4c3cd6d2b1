"""Quality rules as a learned decision list.

Statistics of every text are measured in Arrow batches. Sequential covering
grows conjunctions of thresholds on labelled statistics by information gain and
prunes them on rows it didn't grow on; the ordered rules become one Spark
conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, SPACES, column, slices, spread, tidy, utf8
from .words import windows, words

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_BATCH = 2 << 20
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_chars_all", "n_kinds"]


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(found, rows: int) -> np.ndarray:
    """Words in 3-word windows that occur twice or more in their text, each word once."""
    grams, first = windows(found.hashes, found.row, 3)
    out = np.zeros(rows, np.int64)
    if not len(grams):
        return out
    row = found.row[first]
    order = np.lexsort((grams, row))
    same = (grams[order][1:] == grams[order][:-1]) & (row[order][1:] == row[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(found.row), bool)
    at = first[order[twice]]
    for k in range(3):
        covered[at + k] = True
    return np.bincount(found.row[covered], minlength=rows)


def measure(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The COUNTS of each row, from its UTF-8 bytes."""
    rows = len(offsets) - 1
    found = words(raw, offsets, table=None)
    points = (raw & 0xC0) != 0x80  # the first byte of each code point
    spaces = _SPACE[raw]
    kinds = np.zeros(rows, np.int64)
    if len(found.hashes):
        order = np.lexsort((found.hashes, found.row))
        h, r = found.hashes[order], found.row[order]
        kinds = np.bincount(r[np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])], minlength=rows)
    data = raw.tobytes()
    lines, repeats = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        own = [x for x in data[a:b].split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        lines[k] = len(own)
        repeats[k] = len(own) - len(set(own))
    return {
        "n_words": found.counts(rows),
        "word_chars": _per_row(points & ~spaces, offsets),
        "n_symbols": _per_row(_SYMBOL[raw], offsets),
        "n_dup_lines": repeats,
        "n_repeat_words": _repeated(found, rows),
        "n_lines": lines,
        "n_upper": _per_row((raw >= 65) & (raw <= 90), offsets),
        "n_digits": _per_row((raw >= 48) & (raw <= 57), offsets),
        "n_marks": _per_row((raw == 33) | (raw == 63), offsets),
        "n_chars_all": _per_row(points, offsets),
        "n_kinds": kinds,
    }


def _measure(batches: Batches) -> Batches:
    for batch in batches:
        raw, offsets = utf8(batch.column(1))
        for a, b in slices(offsets, _BATCH):
            counts = measure(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.record_batch([batch.column(0).slice(a, b - a), *[pa.array(counts[c].astype(np.int64)) for c in COUNTS]], ["doc_id", *COUNTS])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and COUNTS of every text; null texts have none of anything."""
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col))
    return rows.mapInArrow(tidy(_measure), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def ratios() -> dict[str, Column]:
    """What the rules test, by name."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_chars_all"), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / n,
        "symbol_rate": F.col("n_symbols") / n,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_rate": F.col("n_repeat_words") / n,
        "upper_rate": F.col("n_upper") / chars,
        "digit_rate": F.col("n_digits") / chars,
        "mark_rate": F.col("n_marks") / chars,
        "kind_rate": F.col("n_kinds") / n,
    }


Rule = list[tuple[str, str, float]]


@dataclass
class DecisionList:
    """Rules that reject, in order; a text that none covers is kept."""

    rules: list[Rule]

    def expression(self) -> Column:
        """The number of the first rule that covers a row, else 0."""
        named, out = ratios(), F.lit(0)
        for k in range(len(self.rules) - 1, -1, -1):
            test = F.lit(True)
            for name, sign, value in self.rules[k]:
                test = test & (named[name] > value if sign == ">" else named[name] <= value)
            out = F.when(test, F.lit(k + 1)).otherwise(out)
        return out


def _covers(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, sign, value in rule:
        column = x[:, names.index(name)]
        out &= column > value if sign == ">" else column <= value
    return out


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], most: int, cuts: int) -> Rule:
    rule: Rule = []
    inside = np.ones(len(x), bool)
    while len(rule) < most and (inside & ~y).any():
        p0, n0 = (inside & y).sum(), (inside & ~y).sum()
        best, found = 1e-9, None
        for j, name in enumerate(names):
            column, positive = x[inside, j], y[inside]
            seen = np.unique(column)
            low = np.unique(np.linspace(0, len(seen) - 2, min(cuts, len(seen) - 1)).astype(int)) if len(seen) > 1 else []
            for value in (seen[k] + (seen[k + 1] - seen[k]) / 2 for k in low):
                above = column > value
                for sign, own in ((">", above), ("<=", ~above)):
                    p, n = (own & positive).sum(), (own & ~positive).sum()
                    if p:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best:
                            best, found = gain, (name, sign, float(value))
        if found is None:
            break
        rule = [t for t in rule if t[:2] != found[:2]] + [found]  # a tighter threshold takes the place of its like
        inside &= _covers([found], x, names)
    return rule


def learn(x: np.ndarray, bad: np.ndarray, key: np.ndarray, names: list[str], most_rules: int = 8, most_tests: int = 4, precision: float = 0.9, least: int = 3, cuts: int = 40) -> DecisionList:
    """Sequential covering of the bad rows. A third of the rows (by key) prunes and must confirm each rule."""
    rules: list[Rule] = []
    bad, prune = bad.astype(bool), key % 3 == 0
    open_rows = np.ones(len(x), bool)
    for _ in range(most_rules):
        grow = open_rows & ~prune
        if (bad & grow).sum() < least:
            break
        rule = _grow(x[grow], bad[grow], names, most_tests, cuts)
        check = open_rows & prune

        def worth(r: Rule) -> float:
            own = _covers(r, x, names) & check  # noqa: B023
            p, n = (own & bad).sum(), (own & ~bad).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        own = _covers(rule, x, names) & open_rows
        p, n = (own & bad).sum(), (own & ~bad).sum()
        pc, nc = (own & bad & check).sum(), (own & ~bad & check).sum()
        if not rule or p < least or p < precision * (p + n) or pc < precision * (pc + nc):
            break
        rules.append(rule)
        open_rows &= ~own
    return DecisionList(rules)


def learn_rules(docs: DataFrame, labels: DataFrame, label_col: str = "quality", train_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text", **settings) -> DecisionList:
    """Learns from at most train_rows labelled ids, in a fixed pseudo-random order; label 0 is bad.

    An id that several rows of docs have brings one of its texts (the smallest).
    Without labelled texts there are no rules.
    """
    named = labels.select(column(id_col).alias("label_id"), column(label_col).cast("int").alias("label")).where("label_id is not null and label in (0, 1)")
    named = named.groupBy("label_id").agg(F.min("label").alias("label"))
    chosen = named.withColumn("place", spread(F.col("label_id"), "quality")).orderBy("place", "label_id").limit(train_rows)
    sample = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text")).join(F.broadcast(chosen.withColumnRenamed("label_id", "doc_id")), "doc_id").where("text is not null")
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"))
    facts = statistics(sample, "doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    names = list(ratios())
    rows = facts.select("label", "place", *[c.alias(n) for n, c in ratios().items()]).orderBy("place", *names).toPandas()
    return learn(rows[names].to_numpy(float), rows["label"].to_numpy() == 0, rows["place"].to_numpy(), names, **settings)


def apply_quality_rules(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, rule (0 or the number of the rule that rejects) and kept.

    Null, empty and blank texts have no words and fail the base test. Repeated
    rows give repeated rows. Other columns are ignored. Without rules the base
    test decides alone. An empty table gives an empty table.
    """
    facts = statistics(docs, id_col, text_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    facts = facts.withColumn("base_failed", failed).withColumn("rule", rules.expression())
    kept = ~F.col("base_failed") & (F.col("rule") == 0)
    return facts.select("doc_id", *COUNTS[:5], "base_failed", kept.alias("kept"), "rule")
