"""Datalog over triples: recursive rules with negation, evaluated stratum by stratum, semi-naively.

    ?x kc:within ?y :- ?x kc:partOf ?y .
    ?x kc:within ?z :- ?x kc:within ?y, ?y kc:within ?z .
    ?c kc:idle "true" :- ?c rdf:type kc:Customer, not ?o kc:placedBy ?c, ?c kc:balance ?b, ?b > 100 .

A rule is a head, ``:-``, and a body of patterns, ``not`` patterns and comparisons with a
number or a text.  Each variable of the head, and of a comparison, is in a positive pattern; a
variable that only a ``not`` pattern has stands for anything.

Predicates are put into strata, so that what a rule negates is complete before it is used;
a rule that depends on its own negation is refused.  In a stratum the first round
joins all facts; in each later one a rule is rewritten once for each pattern that can match
new facts: that pattern reads only the last round's new facts, those before it what was
known before that round, those after it everything.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .lineage import table

KEY = ["s", "p", "o"]
TOKEN = re.compile(r'\s*(?:(?P<var>\?\w+)|(?P<text>"(?:[^"\\]|\\.)*")|(?P<number>-?\d+(?:\.\d+)?)(?=[\s,.]|$)|(?P<op>:-|<=|>=|!=|[<>=,.])|(?P<name>[A-Za-z_][\w-]*:[^\s,]*[^\s,.]|<[^>]+>|\w+))')
COMPARE = {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b, "!=": lambda a, b: a != b}
UNIONS = 8  # stored pieces that are read together; more are merged


class DatalogError(ValueError):
    """A rule that cannot be read or has no meaning."""


@dataclass(frozen=True)
class Pattern:
    """Three terms: (kind, value), where kind is var, text or name."""

    terms: tuple[tuple[str, str], ...]
    negated: bool = False

    def variables(self) -> set[str]:
        return {v for k, v in self.terms if k == "var"}

    def predicate(self) -> str | None:
        """None: any."""
        return None if self.terms[1][0] == "var" else self.terms[1][1]


@dataclass(frozen=True)
class Test:
    variable: str
    op: str
    other: tuple[str, str]


@dataclass
class Rule:
    head: Pattern
    body: list[Pattern] = field(default_factory=list)
    tests: list[Test] = field(default_factory=list)


def parse(text: str) -> list[Rule]:
    tokens, at = [], 0
    text = re.sub(r"(?m)^\s*#.*$", "", text).rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise DatalogError(f"cannot read {text[at : at + 30]!r}")
        value = m[m.lastgroup]
        kind = m.lastgroup
        if kind == "text":
            value = re.sub(r"\\(.)", r"\1", value[1:-1])
        if kind == "name" and value[0] == "<":
            value = value[1:-1]
        tokens.append((kind, value))
        at = m.end()
    rules, i = [], 0

    def pattern(negated: bool = False) -> Pattern:
        nonlocal i
        terms = tokens[i : i + 3]
        if len(terms) < 3 or any(k == "op" for k, _ in terms):
            raise DatalogError(f"three terms are missing at {terms}")
        i += 3
        return Pattern(tuple(("text", v) if k == "number" else (k, v) for k, v in terms), negated)

    while i < len(tokens):
        rule = Rule(pattern())
        if tokens[i : i + 1] != [("op", ":-")]:
            raise DatalogError(f"':-' is missing after the head {rule.head.terms}")
        i += 1
        while True:
            if tokens[i : i + 1] == [("name", "not")]:
                i += 1
                rule.body.append(pattern(negated=True))
            elif i + 2 < len(tokens) and tokens[i][0] == "var" and tokens[i + 1][0] == "op" and tokens[i + 1][1] in COMPARE:
                rule.tests.append(Test(tokens[i][1], tokens[i + 1][1], tokens[i + 2]))
                i += 3
            else:
                rule.body.append(pattern())
            end = tokens[i : i + 1]
            i += 1
            if end == [("op", ".")]:
                break
            if end != [("op", ",")]:
                raise DatalogError("',' or '.' is missing in a body")
        bound = set().union(set(), *(p.variables() for p in rule.body if not p.negated))
        used = rule.head.variables() | {t.variable for t in rule.tests} | {t.other[1] for t in rule.tests if t.other[0] == "var"}
        if not bound or used - bound:
            raise DatalogError(f"no pattern binds {sorted(used - bound) or 'anything'}")
        rules.append(rule)
    return rules


def strata(rules: list[Rule]) -> list[list[Rule]]:
    """The rules in order: what one negates is derived before it."""
    heads = {r.head.predicate() for r in rules}
    level = dict.fromkeys(heads, 0)

    def sources(p: Pattern) -> Iterable[str | None]:
        return heads if p.predicate() is None else [h for h in heads if h is None or h == p.predicate()]

    for _ in range(len(heads) + 1):
        before = dict(level)
        for r in rules:
            h = r.head.predicate()
            for p in r.body:
                for s in sources(p):
                    level[h] = max(level[h], level[s] + p.negated)
        if before == level:
            return [[r for r in rules if level[r.head.predicate()] == k] for k in sorted(set(level.values()))]
    raise DatalogError("a rule depends on its own negation")


def matches(facts: DataFrame, pattern: Pattern) -> DataFrame:
    """A column for each variable; each combination once a fact."""
    columns: dict[str, str] = {}
    rows = facts
    for name, (kind, value) in zip(KEY, pattern.terms, strict=True):
        if kind != "var":
            rows = rows.where(F.col(name) == F.lit(value))
        elif value in columns:
            rows = rows.where(F.col(name) == F.col(columns[value]))
        else:
            columns[value] = name
    return rows.select(*[F.col(c).alias(v) for v, c in columns.items()])


def derived(rule: Rule, sources: list[DataFrame], facts: DataFrame) -> DataFrame:
    """s, p, o of the rule's head, where its k-th positive pattern reads ``sources[k]`` and negated ones ``facts``."""
    positive = [p for p in rule.body if not p.negated]
    left = list(range(len(positive)))
    out, bound = None, set()
    while left:
        k = next((k for k in left if out is None or positive[k].variables() & bound), None)
        if k is None:
            raise DatalogError("patterns without a variable in common would be a cross join")
        left.remove(k)
        own = matches(sources[k], positive[k])
        common = sorted(positive[k].variables() & bound)
        out = own if out is None else out.join(own, common)
        bound |= positive[k].variables()
    for p in rule.body:
        if p.negated:
            common = sorted(p.variables() & bound)
            out = out.join(matches(facts, p).select(*common).distinct(), common, "left_anti") if common else out.where(F.lit(matches(facts, p).isEmpty()))
    for t in rule.tests:
        a = F.col(t.variable)
        if t.other[0] == "number":
            out = out.where(COMPARE[t.op](a.try_cast("double"), F.lit(float(t.other[1]))))
        elif t.other[0] == "var":
            b = F.col(t.other[1])
            numbers = a.try_cast("double").isNotNull() & b.try_cast("double").isNotNull()
            out = out.where(F.when(numbers, COMPARE[t.op](a.try_cast("double"), b.try_cast("double"))).otherwise(COMPARE[t.op](a, b)))
        else:
            out = out.where(COMPARE[t.op](a, F.lit(t.other[1])))
    return out.select(*[(F.col(v) if k == "var" else F.lit(v)).alias(c) for c, (k, v) in zip(KEY, rule.head.terms, strict=True)])


def infer(facts: DataFrame, rules: str | list[Rule], rounds: int = 1000, seen: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """s, p, o that the rules add to ``facts``. ``seen`` gets (stratum, round, new facts)."""
    rules = parse(rules) if isinstance(rules, str) else rules
    given = table(facts.select(*KEY).where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").distinct(), "facts")
    made: list[DataFrame] = []
    everything = lambda pieces: reduce(DataFrame.unionByName, pieces)
    for number, layer in enumerate(strata(rules)):
        heads = {r.head.predicate() for r in layer}
        fresh = lambda p: None in heads or p.predicate() is None or p.predicate() in heads  # noqa: E731, B023
        old, new = None, None  # made before the last round; in it
        for turn in range(rounds):
            known = everything([given, *made])
            parts = []
            for r in layer:
                positive = [p for p in r.body if not p.negated]
                if new is None:
                    parts.append(derived(r, [known] * len(positive), known))
                    continue
                for k, p in enumerate(positive):
                    if fresh(p):
                        parts.append(derived(r, [old] * k + [new] + [known] * (len(positive) - k - 1), known))
            if not parts:
                break
            found = table(everything(parts).distinct().join(known, KEY, "left_anti"), "derived")
            n = found.count()
            if seen is not None:
                seen.append((number, turn, n))
            if not n:
                break
            old, new = known, found
            made.append(found)
            if len(made) > UNIONS:
                made = [table(everything(made), "derived")]
        else:
            raise RuntimeError(f"no fixpoint in {rounds} rounds")
    return everything(made) if made else given.limit(0)
