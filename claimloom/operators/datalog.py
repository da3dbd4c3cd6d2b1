"""Rules over facts: bodies become joins, negation anti-joins, recursion a semi-naive fixpoint.

A rule is head <= term, term, ... where the head and terms name relations:
name(arg, ...). Arguments are variables (capitalised; _ is any value), quoted
texts and numbers. ~name(...) holds where no row matches, and variables compare
with each other and with constants by < <= > >= == !=. Relations are DataFrames
whose columns stand by position. Every variable of a head, a negation or a
comparison has to stand in a positive term, and positive terms have to share
variables: a rule that needs a cross join is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

ERRORS = "validation_error"
_ATOM = re.compile(r"(~?)\s*([a-z]\w*)\(((?:[^()']|'[^']*')*)\)\s*")
_COMPARISON = re.compile(r"([A-Z]\w*)\s*(<=|>=|==|!=|<|>)\s*([A-Z]\w*|-?\d+(?:\.\d+)?|'[^']*')\s*")
_ARGUMENT = re.compile(r"\s*('[^']*'|[A-Z_]\w*|-?\d+(?:\.\d+)?)\s*(?:,|$)")
_COMPARE = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__, "==": Column.__eq__, "!=": Column.__ne__}


@dataclass(frozen=True)
class Atom:
    name: str
    args: tuple[str, ...]
    negated: bool = False

    @property
    def variables(self) -> list[str]:
        return [a for a in dict.fromkeys(self.args) if a[0].isupper()]


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[Atom, ...]
    comparisons: tuple[tuple[str, str, str], ...]


def _atom(found: re.Match) -> Atom:
    args, at = [], 0
    while at < len(found[3]):
        each = _ARGUMENT.match(found[3], at)
        if each is None:
            raise ValueError(f"not an argument: {found[3][at:]}")
        args.append(each[1])
        at = each.end()
    return Atom(found[2], tuple(args), found[1] == "~")


def read(text: str) -> Rule:
    """A rule from its text; ValueError where the text is none, or leaves a variable unbound."""
    head = _ATOM.match(text.strip())
    if head is None or head[1] or not text.strip()[head.end() :].startswith("<="):
        raise ValueError(f"not a rule: {text}")
    rest, at, body, comparisons = text.strip()[head.end() + 2 :].strip(), 0, [], []
    while at < len(rest):
        found = _ATOM.match(rest, at)
        if found:
            body.append(_atom(found))
        else:
            found = _COMPARISON.match(rest, at)
            if found is None:
                raise ValueError(f"not a term: {rest[at:]}")
            comparisons.append((found[1], found[2], found[3]))
        at = found.end()
        if at < len(rest):
            if rest[at] != ",":
                raise ValueError(f"not a term: {rest[at:]}")
            at = re.compile(r",\s*").match(rest, at).end()
    rule = Rule(_atom(head), tuple(body), tuple(comparisons))
    bound = {v for a in body if not a.negated for v in a.variables}
    needed = {*rule.head.variables, *(v for a in body if a.negated for v in a.variables), *(v for c in comparisons for v in (c[0], c[2]) if v[0].isupper())}
    if needed - bound or "_" in rule.head.args:
        raise ValueError(f"unbound variables {sorted(needed - bound)}: {text}")
    return rule


def _constant(text: str) -> Column:
    return F.lit(text[1:-1]) if text[0] == "'" else F.lit(text).cast("decimal(38,6)")


def _matching(relation: DataFrame, atom: Atom) -> DataFrame:
    """The rows that an atom's constants and repeated variables allow, its variables as columns."""
    if len(relation.columns) != len(atom.args):
        raise ValueError(f"{atom.name} has {len(relation.columns)} columns, not {len(atom.args)}")
    columns, conditions = {}, []
    for name, arg in zip(relation.columns, atom.args, strict=True):
        if arg[0].isupper() and arg in columns:
            conditions.append(columns[arg] == F.col(name))
        elif arg[0].isupper():
            columns[arg] = F.col(name)
        elif arg[0] != "_":
            conditions.append((F.col(name) if arg[0] == "'" else F.col(name).cast("decimal(38,6)")) == _constant(arg))
    kept = relation.where(reduce(Column.__and__, conditions)) if conditions else relation
    return kept.select(*[c.alias(v) for v, c in columns.items()] or [F.lit(1).alias("_")])


def _holds(rows: DataFrame, comparison: tuple[str, str, str]) -> Column:
    left, sign, right = comparison
    if right[0].isupper():
        kinds = {v: dict(rows.dtypes)[v] for v in (left, right)}
        texts = [v for v, k in kinds.items() if k == "string"]
        one, two = (F.col(v).cast("decimal(38,6)") if len(texts) == 1 and v in texts else F.col(v) for v in (left, right))
        return _COMPARE[sign](one, two)
    value = F.col(left) if right[0] == "'" else F.expr(f"try_cast({left} AS decimal(38,6))")
    return _COMPARE[sign](value, _constant(right))


def _body(rule: Rule, relation: Mapping[str, DataFrame], first: int | None = None, rows_of_first: DataFrame | None = None) -> DataFrame:
    """The head's rows; the body's positive term number `first` reads the given rows instead of its relation."""
    left = [k for k, a in enumerate(rule.body) if not a.negated]
    if not left:
        raise ValueError(f"no positive term: {rule}")
    read_at = lambda k: _matching(rows_of_first if k == first else relation[rule.body[k].name], rule.body[k])
    start = left[0] if first is None else first
    left.remove(start)
    rows, waiting, denied = read_at(start), list(rule.comparisons), [a for a in rule.body if a.negated]
    while True:
        for c in [c for c in waiting if all(v in rows.columns for v in (c[0], c[2]) if v[0].isupper())]:
            rows = rows.where(_holds(rows, c))
            waiting.remove(c)
        if not left:
            break
        sharing = [k for k in left if set(rule.body[k].variables) & set(rows.columns)]
        if not sharing:
            raise ValueError(f"terms share no variable: {rule}")
        left.remove(sharing[0])
        rows = rows.join(read_at(sharing[0]), [v for v in rule.body[sharing[0]].variables if v in rows.columns])
    for atom in denied:
        if not atom.variables:
            raise ValueError(f"a negation without variables: {rule}")
        rows = rows.join(_matching(relation[atom.name], atom), atom.variables, "left_anti")
    columns = [F.col(a) if a[0].isupper() else (F.lit(a[1:-1]) if a[0] == "'" else _constant(a)) for a in rule.head.args]
    return rows.select(*[c.alias(f"_{k}") for k, c in enumerate(columns)]).distinct()


def _strata(rules: Iterable[Rule], given: Iterable[str]) -> list[set[str]]:
    """Derived relations in the order of evaluation, those that depend on each other together."""
    rules = list(rules)
    derived = {r.head.name for r in rules}
    unknown = {a.name for r in rules for a in r.body} - derived - set(given)
    if unknown:
        raise ValueError(f"unknown relations: {sorted(unknown)}")
    reach = {p: {a.name for r in rules if r.head.name == p for a in r.body if a.name in derived} for p in derived}
    for _ in derived:
        reach = {p: q.union(*(reach[x] for x in q)) for p, q in reach.items()}
    for r in rules:
        for a in r.body:
            if a.negated and a.name in derived and r.head.name in reach[a.name] | {a.name}:
                raise ValueError(f"{a.name} is negated in its own recursion")
    groups = {frozenset({p, *(q for q in reach[p] if p in reach[q])}) for p in derived}
    return [set(g) for g in sorted(groups, key=lambda g: (len(set().union(*(reach[p] for p in g)) - g), sorted(g)))]


def evaluate(texts: Iterable[str], facts: Mapping[str, DataFrame], want: str, arity: int | None = None, most: int = 200) -> DataFrame:
    """The distinct rows of one relation under the rules; columns _0, _1, ...

    Relations that don't recurse become parts of one plan. Recursive ones are
    written round by round to the shared folder: a round joins the rows that the
    round before found new, and goes on with what isn't known yet. A relation
    that no rule derives and no fact has is empty; `arity` then says its columns.
    """
    rules = [read(t) for t in texts]
    known = dict(facts)
    for group in _strata(rules, known):
        own = [r for r in rules if r.head.name in group]
        recursive = [(r, k) for r in own for k, a in enumerate(r.body) if a.name in group and not a.negated]
        seeds = {p: [_body(r, known) for r in own if r.head.name == p and not any(r is x for x, _ in recursive)] for p in group}
        for p in group:
            seeds[p] += [facts[p].toDF(*[f"_{k}" for k in range(len(facts[p].columns))])] if p in facts else []
        if any(not s for s in seeds.values()) and recursive:
            lone = sorted(p for p, s in seeds.items() if not s)
            raise ValueError(f"recursion without a start: {lone}")
        found = {p: reduce(DataFrame.union, s).distinct() if len(s) > 1 else s[0] for p, s in seeds.items()}
        if recursive:
            found = {p: written(df.distinct(), f"datalog-{p}") for p, df in found.items()}
            new = dict(found)
            for _ in range(most):
                known |= found
                parts: dict[str, list[DataFrame]] = {p: [] for p in group}
                for r, k in recursive:
                    parts[r.head.name].append(_body(r, known, k, new[r.body[k].name]))
                new = {p: written(reduce(DataFrame.union, s).distinct().join(found[p], found[p].columns, "left_anti"), f"datalog-{p}") if s else found[p].limit(0) for p, s in parts.items()}
                if all(df.isEmpty() for df in new.values()):
                    break
                found = {p: df.union(new[p]) for p, df in found.items()}
            else:
                raise RuntimeError(f"{sorted(group)} did not settle in {most} rounds")
        known |= found
    if want not in known:
        if arity is None:
            raise ValueError(f"unknown relation: {want}")
        some = next(iter(facts.values()))
        return some.limit(0).select(*[F.lit("").alias(f"_{k}") for k in range(arity)])
    return known[want].toDF(*[f"_{k}" for k in range(len(known[want].columns))])
