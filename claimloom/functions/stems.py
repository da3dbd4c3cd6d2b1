"""An English suffix stemmer as column expressions, and the same rules as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that searches leave out.
STOP = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "were", "with"]
_V, _C = "[aeiouy]", "[^aeiouy]"
# Derived suffixes and what stands for them; a vowel and a consonant have to come before.
DERIVED = [
    ("ational", "ate"), ("tional", "tion"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("biliti", "ble"), ("aliti", "al"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("alli", "al"), ("entli", "ent"), ("ousli", "ous"), ("eli", "e"),
]
# Endings that go after two such pairs.
ENDINGS = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]
_PAIR, _PAIRS = f".*{_V}{_C}+", f".*{_V}{_C}+{_V}+{_C}+"
#: Groups of rules (pattern, tail), one after another. Of a group the first pattern that matches counts: its first group and the tail stand for the word.
GROUPS: list[list[tuple[str, str]]] = [
    [("^(.*)sses$", "ss"), ("^(..+)ies$", "i"), ("^(.)ies$", "ie"), (f"^(.*{_V}.*[^su])s$", "")],
    [(f"^({_PAIR})eed$", "ee"), ("^(.*at)(?:ed|ing)$", "e"), (f"^(.*{_V}.*bl)(?:ed|ing)$", "e"), ("^(.*iz)(?:ed|ing)$", "e"), *[(f"^(.*{_V}){c}{c}(?:ed|ing)$", c) for c in "bdfgmnprt"], (f"^(.*{_V}.*)(?:ed|ing)$", "")],
    [(f"^(.*{_V}.*{_C})y$", "i")],
    [(f"^({_PAIR}){end}$", other) for end, other in DERIVED],
    [(f"^({_PAIRS}){end}$", "") for end in ENDINGS] + [(f"^(.*{_V}{_C}+{_V}+{_C}*[st])ion$", "")],
    [(f"^({_PAIRS})e$", ""), (f"^(.*{_V}{_C}{_C}+)e$", ""), (f"^({_PAIR}{_V}+)e$", ""), (f"^({_PAIR}{_V}+)ll$", "l")],
]


def _rewritten(group: list[tuple[str, str]], word: Column) -> Column:
    out = word
    for pattern, tail in reversed(group):
        out = F.when(word.rlike(pattern), F.concat(F.regexp_extract(word, pattern, 1), F.lit(tail))).otherwise(out)
    return out


def _rewriter(group: list[tuple[str, str]]) -> Callable[[Column], Column]:
    return lambda word: _rewritten(group, word)


def stem(word: Column) -> Column:
    """The stem of a lower-case word; words of fewer than three letters, and those with digits, stay.

    Each group's result goes on as a lambda's variable: written out, it would
    stand in the next group's rules again and again.
    """
    out = word
    for group in GROUPS:
        out = F.element_at(F.transform(F.array(out), _rewriter(group)), 1)
    return F.when(word.rlike("^[a-z]{3,}$"), out).otherwise(word)


def stem_sql(source: str) -> str:
    """DuckDB tables stem0, stem1, ... that rewrite `word` of a table group by group; the last has word and term."""
    tables, before = [f"stem0 AS MATERIALIZED (SELECT word, word AS w FROM {source})"], "stem0"
    for k, group in enumerate(GROUPS, 1):
        cases = " ".join(f"WHEN regexp_matches(w, '{p}') THEN regexp_extract(w, '{p}', 1) || '{tail}'" for p, tail in group)
        tables.append(f"stem{k} AS MATERIALIZED (SELECT word, CASE {cases} ELSE w END AS w FROM {before})")
        before = f"stem{k}"
    return ", ".join(tables) + f", stemmed AS (SELECT word, CASE WHEN regexp_matches(word, '^[a-z]{{3,}}$') THEN w ELSE word END AS term FROM {before})"
