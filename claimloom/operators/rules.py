"""Rules kept as text, turned into Spark conditions over claims.

A rule is a head and a conjunction: validation_error(C, 'ID', 'field', 'message')
<= term, term, ... A term is claim_attribute(C, 'name', V), a fact about a value
as in master_facility_active(V) or its negation ~master_facility_active(V), or a
comparison of a variable with a number or a quoted text. Rules of any other
form are evaluated over tables of facts by operators.datalog.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The shipped rules.
TEXTS = [
    "validation_error(C, 'FACILITY_INACTIVE', 'facility_id', 'Facility ID on claim does not exist or is inactive') <= claim_attribute(C, 'facility_id', F), ~master_facility_active(F)",
    "validation_error(C, 'CHARGE_TOO_LOW', 'total_charge_amount', 'Total charge amount is less than 50') <= claim_attribute(C, 'total_charge_amount', A), A < 50",
    "validation_error(C, 'CHARGE_TOO_HIGH', 'total_charge_amount', 'Total charge amount is over 20000') <= claim_attribute(C, 'total_charge_amount', A), A > 20000",
]
#: Columns behind attributes and facts.
ATTRIBUTES = {"facility_id": "facility_id", "financial_class_id": "financial_class_id", "total_charge_amount": "total_charge"}
FACTS = {"master_facility_active": "facility_active", "master_facility_exists": "facility_known"}

_HEAD = re.compile(r"\s*validation_error\(\s*(\w+)\s*,\s*'([^']*)'\s*,\s*'([^']*)'\s*,\s*'([^']*)'\s*\)\s*<=\s*(.+)", re.S)
_TERM = re.compile(r"(?P<no>~?)\s*(?P<name>[a-z]\w*)\(\s*(?P<args>[^)]*)\)|(?P<left>[A-Z]\w*)\s*(?P<sign><=|>=|==|!=|<|>)\s*(?P<right>-?[0-9.]+|'[^']*')")
_SIGNS = {"<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__", "==": "__eq__", "!=": "__ne__"}


def condition(text: str, attributes: Mapping[str, str] = ATTRIBUTES, facts: Mapping[str, str] = FACTS) -> tuple[str, str, str, Column]:
    """(rule id, field, message, condition) of one rule; ValueError where the text is none."""
    head = _HEAD.fullmatch(text.strip())
    if head is None:
        raise ValueError(f"not a rule: {text}")
    claim, rule, field, message, body = head.groups()
    bound: dict[str, Column] = {}
    out, at = F.lit(True), 0
    for term in _TERM.finditer(body):
        if body[at : term.start()].strip(" ,\n\t"):
            raise ValueError(f"not a term: {body[at : term.start()]}")
        at = term.end()
        args = [a.strip() for a in (term["args"] or "").split(",")]
        if term["name"] == "claim_attribute" and not term["no"] and len(args) == 3 and args[0] == claim:
            column = F.col(attributes[args[1].strip("'")])
            bound[args[2]] = column
            out = out & column.isNotNull() & (column.cast("string") != "")
        elif term["name"] == "claim" and args == [claim]:
            continue
        elif term["name"] in facts and len(args) == 1 and args[0] in bound:
            holds = F.coalesce(F.col(facts[term["name"]]), F.lit(False))
            out = out & (~holds if term["no"] else holds)
        elif term["left"] in bound:
            value = F.lit(term["right"].strip("'")) if term["right"][0] == "'" else F.lit(term["right"]).cast("decimal(38,6)")
            out = out & getattr(bound[term["left"]], _SIGNS[term["sign"]])(value)
        else:
            raise ValueError(f"not a term: {term[0]}")
    if body[at:].strip() or not bound:
        raise ValueError(f"not a rule: {text}")
    return rule, field, message, F.coalesce(out, F.lit(False))


def split(texts: list[str]) -> tuple[list[str], list[str]]:
    """Rules that one claim's columns decide, and all others, which need facts to be joined."""
    plain, joined = [], []
    for text in texts:
        try:
            condition(text)
            plain.append(text)
        except (ValueError, KeyError):
            joined.append(text)
    return plain, joined


def apply(claims: DataFrame, texts: list[str]) -> DataFrame:
    """claim_id, rule_id, field, message of each rule that holds, in one pass; claims carry the columns behind facts."""
    found = [condition(t) for t in texts]
    if not found:
        return claims.limit(0).select("claim_id", *[F.lit("").alias(c) for c in ("rule_id", "field", "message")])
    each = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(r).alias("rule_id"), F.lit(f).alias("field"), F.lit(m).alias("message"))) for r, f, m, c in found]))
    return claims.select("claim_id", F.inline(each))
