"""SPARQL on quads: a recursive-descent parser and its compilation to DataFrames.

Supported: SELECT [DISTINCT] with COUNT, SUM, MIN, MAX, AVG, GROUP_CONCAT, SAMPLE (alone or
inside expressions), GROUP BY, HAVING, ORDER BY, LIMIT, OFFSET; sub-SELECT; ASK; CONSTRUCT;
DESCRIBE; FROM; GRAPH; SERVICE [SILENT]; basic graph patterns with ; and , and property paths
(/ | ^ + * ? ! and brackets);
OPTIONAL; UNION; MINUS; FILTER and FILTER [NOT] EXISTS; VALUES with UNDEF; BIND; INSERT
DATA, DELETE DATA, DELETE WHERE, and DELETE/INSERT ... WHERE.

A solution is a DataFrame with a column ``x`` for ?x and ``x@`` for its kind (iri,
literal, bnode), and the set of the variables that it may leave unbound (null).  Those
are compatible with any value and are filled by it; all others join by equality.
Filters of OPTIONAL and EXISTS see the variables around them: they belong to the join's
condition.  MINUS takes away only what has a variable in common.

Each triple pattern is one filtered scan; constants reach the scan as
filters, so a graph name prunes partitions.  Patterns join in an order that starts
with the most constants and stays connected; Catalyst chooses how.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.graph import fixpoint
from .lineage import cut

TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>\s]*>)|(?P<string>"(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+|\^\^(?:<[^>]*>|[\w-]+:[\w-]+))?)|(?P<var>[?$]\w+)|(?P<number>[+-]?\d+(?:\.\d+)?)"""
    r"""|(?P<name>(?:[A-Za-z_][\w-]*)?:(?:(?:[\w.\-]|/(?![A-Za-z_][\w-]*:|:))*[\w\-])?)|(?P<word>[A-Za-z_]\w*)|(?P<op>&&|\|\||!=|<=|>=|[{}().;,=<>!*/+\-^|?])""",
    re.X,
)


class SparqlError(ValueError):
    pass


@dataclass(frozen=True)
class Term:
    kind: str  # var, iri, literal
    value: str
    number: bool = field(default=False, compare=False)  # written as one


@dataclass
class Group:
    triples: list[tuple[Term, Term, Term]] = field(default_factory=list)
    parts: list[tuple] = field(default_factory=list)  # (what, ...), in order
    filters: list = field(default_factory=list)


Solutions = tuple[DataFrame, frozenset[str]]  # with the variables that may be unbound


@dataclass
class Query:
    form: str
    where: Group | None = None
    select: list[tuple[str, tuple | None]] = field(default_factory=list)  # (name, expression); empty: all
    distinct: bool = False
    template: list[tuple[Term, Term, Term]] = field(default_factory=list)
    delete: list[tuple[Term, Term, Term]] = field(default_factory=list)
    graph: str | None = None
    group_by: list[str] = field(default_factory=list)
    having: list[tuple] = field(default_factory=list)
    order: list[tuple[tuple, bool]] = field(default_factory=list)
    targets: list[Term] = field(default_factory=list)  # of DESCRIBE
    limit: int | None = None
    offset: int = 0


IRI_LIKE = r"^[A-Za-z][\w-]*:\S+$"
MOST_KEYS = 1000  # values that are sent to another store as a filter; beyond them its rows are joined as they are
AGGREGATES = {"COUNT", "SUM", "MIN", "MAX", "AVG", "GROUP_CONCAT", "SAMPLE"}


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise SparqlError(f"cannot read {text[at : at + 20]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.i, self.prefixes = 0, {}

    def peek(self, n: int = 0) -> tuple[str, str]:
        return self.tokens[self.i + n] if self.i + n < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        self.i += 1
        return self.tokens[self.i - 1] if self.i <= len(self.tokens) else ("end", "")

    def word(self, *words: str) -> str | None:
        kind, value = self.peek()
        if kind in ("word", "op") and value.upper() in words:
            self.i += 1
            return value.upper()
        return None

    def need(self, value: str) -> None:
        if self.next()[1].upper() != value:
            raise SparqlError(f"{value} is missing before {self.tokens[self.i - 1 :][:3]}")

    def term(self) -> Term:
        kind, value = self.next()
        if kind == "var":
            return Term("var", value[1:])
        if kind == "iri":
            return Term("iri", value[1:-1])
        if kind == "name":
            prefix, local = value.split(":", 1)
            return Term("iri", self.prefixes[prefix] + local if prefix in self.prefixes else value)
        if kind == "string":
            body = re.match(r'"((?:[^"\\]|\\.)*)"', value)[1]
            return Term("literal", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), body))
        if kind == "number":
            return Term("literal", value, number=True)
        if kind == "word" and value == "a":
            return Term("iri", "rdf:type")
        if kind == "word" and value.lower() in ("true", "false"):
            return Term("literal", value.lower())
        raise SparqlError(f"a term is missing at {value!r}")

    def path(self):
        """A term, or ("alt" | "seq", parts), ("inv" | "plus" | "star" | "opt", part) or ("not", [(predicate, whether backwards)])."""
        options = [self.sequence()]
        while self.word("|"):
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("alt", options)

    def sequence(self):
        steps = [self.step()]
        while self.word("/"):
            steps.append(self.step())
        return steps[0] if len(steps) == 1 else ("seq", steps)

    def step(self):
        if self.word("^"):
            return ("inv", self.step())
        if self.word("!"):
            several, barred = self.word("("), []
            while True:
                back = bool(self.word("^"))
                barred.append((self.term(), back))
                if not several or not self.word("|"):
                    break
            if several:
                self.need(")")
            return ("not", barred)
        if self.word("("):
            p = self.path()
            self.need(")")
        else:
            p = self.term()
        if how := self.word("+", "*", "?"):
            p = ({"+": "plus", "*": "star", "?": "opt"}[how], p)
        return p

    def triples(self, stop: str = "}") -> list[tuple]:
        """(s, p, o), where p may be a path other than a sequence of terms."""
        out: list[tuple] = []
        s = self.term()
        while True:
            path = self.path()
            steps = path[1] if isinstance(path, tuple) and path[0] == "seq" else [path]
            while True:
                o, at = self.term(), s
                for k, p in enumerate(steps[:-1]):
                    mid = Term("var", f"_path{self.i}_{k}")
                    out.append((at, p, mid))
                    at = mid
                out.append((at, steps[-1], o))
                if not self.word(","):
                    break
            if not self.word(";") or self.peek()[1] in (".", stop):
                return out

    def group(self) -> Group:
        self.need("{")
        g = Group()
        while not self.word("}"):
            if self.word("OPTIONAL"):
                g.parts.append(("optional", self.group()))
            elif self.word("MINUS"):
                g.parts.append(("minus", self.group()))
            elif self.word("GRAPH"):
                name = self.term()
                g.parts.append(("graph", name, self.group()))
            elif self.word("SERVICE"):
                silent = bool(self.word("SILENT"))
                g.parts.append(("service", self.term(), silent, self.group()))
            elif self.word("FILTER"):
                if self.word("EXISTS"):
                    g.parts.append(("exists", self.group()))
                elif self.peek()[1].upper() == "NOT" and self.peek(1)[1].upper() == "EXISTS":
                    self.i += 2
                    g.parts.append(("not_exists", self.group()))
                else:
                    g.filters.append(self.primary())
            elif self.word("BIND"):
                self.need("(")
                e = self.expression()
                self.need("AS")
                g.parts.append(("bind", self.term().value, e))
                self.need(")")
            elif self.word("VALUES"):
                g.parts.append(self.values())
            elif self.peek()[1].upper() == "SELECT":
                g.parts.append(("select", self.query()))
            elif self.peek()[1] == "{" and self.peek(1)[1].upper() == "SELECT":
                self.need("{")
                g.parts.append(("select", self.query()))
                self.need("}")
            elif self.peek()[1] == "{":
                branches = [self.group()]
                while self.word("UNION"):
                    branches.append(self.group())
                g.parts.append(("union", branches))
            else:
                found = self.triples()
                g.parts.append(("triples", [t for t in found if isinstance(t[1], Term)]))
                g.parts += [("path", *t) for t in found if not isinstance(t[1], Term)]
            self.word(".")
        return g

    def values(self) -> tuple:
        many = bool(self.word("("))
        names = []
        while self.peek()[0] == "var":
            names.append(self.term().value)
        if many:
            self.need(")")
        self.need("{")
        rows = []
        while not self.word("}"):
            if many:
                self.need("(")
                rows.append([self.value() for _ in names])
                self.need(")")
            else:
                rows.append([self.value()])
        return ("values", names, rows)

    def value(self) -> Term | None:
        return None if self.word("UNDEF") else self.term()

    # expressions: tuples (operator, operands)

    def expression(self) -> tuple:
        e = self.conjunction()
        while self.word("||"):
            e = ("or", e, self.conjunction())
        return e

    def conjunction(self) -> tuple:
        e = self.comparison()
        while self.word("&&"):
            e = ("and", e, self.comparison())
        return e

    def comparison(self) -> tuple:
        e = self.sum()
        if op := self.word("=", "!=", "<", ">", "<=", ">="):
            return (op, e, self.sum())
        negated = self.peek()[1].upper() == "NOT" and self.word("NOT")
        if self.word("IN"):
            self.need("(")
            items = []
            while not self.word(")"):
                items.append(self.expression())
                self.word(",")
            return ("not", ("in", e, *items)) if negated else ("in", e, *items)
        return e

    def sum(self) -> tuple:
        e = self.product()
        while op := self.word("+", "-"):
            e = (op, e, self.product())
        return e

    def product(self) -> tuple:
        e = self.primary()
        while op := self.word("*", "/"):
            e = (op, e, self.primary())
        return e

    def primary(self) -> tuple:
        if self.word("!"):
            return ("not", self.primary())
        if self.word("("):
            e = self.expression()
            self.need(")")
            return e
        kind, value = self.peek()
        if kind == "word" and self.peek(1)[1] == "(":
            self.i += 2
            name = value.upper()
            distinct = bool(self.word("DISTINCT"))
            args = []
            while not self.word(")"):
                if self.word(";"):  # GROUP_CONCAT(... ; SEPARATOR = "...")
                    self.need("SEPARATOR")
                    self.need("=")
                args.append(("all",) if self.word("*") else self.expression())
                self.word(",")
            return ("call", name, distinct, args)
        t = self.term()
        return ("term", t)

    def quads(self) -> tuple[str | None, list[tuple[Term, Term, Term]]]:
        """{ [GRAPH g {] triples [}] }"""
        self.need("{")
        graph, out = None, []
        inner = self.word("GRAPH")
        if inner:
            graph = self.term().value
            self.need("{")
        while not self.word("}"):
            out += self.triples()
            self.word(".")
        if any(not isinstance(t[1], Term) for t in out):
            raise SparqlError("a path cannot stand in a template")
        if inner:
            self.need("}")
        return graph, out

    def query(self) -> Query:
        while self.word("PREFIX"):
            prefix = self.next()[1].rstrip(":")
            self.prefixes[prefix] = self.next()[1][1:-1]
        q = Query(self.word("SELECT", "ASK", "CONSTRUCT", "DESCRIBE", "INSERT", "DELETE") or "")
        if q.form == "SELECT":
            q.distinct = bool(self.word("DISTINCT"))
            while not self.word("*"):
                if self.peek()[0] == "var":
                    q.select.append((self.term().value, None))
                elif self.word("("):
                    e = self.expression()
                    self.need("AS")
                    q.select.append((self.term().value, e))
                    self.need(")")
                else:
                    break
        elif q.form == "CONSTRUCT":
            _, q.template = self.quads()
        elif q.form == "DESCRIBE":
            while self.peek()[0] in ("var", "iri", "name"):
                q.targets.append(self.term())
        elif q.form in ("INSERT", "DELETE"):
            if self.word("DATA"):
                q.graph, found = self.quads()
                q.template, q.delete = (found, []) if q.form == "INSERT" else ([], found)
                q.form = "UPDATE"
                return q
            if q.form == "DELETE" and self.word("WHERE"):
                q.graph, q.delete = self.quads()
                q.where = Group(parts=[("triples", q.delete)])
                q.form = "UPDATE"
                return q
            for _ in range(2):
                if q.form == "DELETE" and not q.delete:
                    q.graph, q.delete = self.quads()
                elif q.form == "INSERT" or self.word("INSERT"):
                    q.graph, q.template = self.quads()
                    break
            q.form = "UPDATE"
        elif q.form != "ASK":
            raise SparqlError("SELECT, ASK, CONSTRUCT, DESCRIBE, INSERT or DELETE is missing")
        if self.word("FROM"):
            q.graph = self.term().value
        if self.word("WHERE") or q.form != "DESCRIBE" or self.peek()[1] == "{":
            q.where = self.group()
        while True:
            if self.word("GROUP"):
                self.need("BY")
                while self.peek()[0] == "var":
                    q.group_by.append(self.term().value)
            elif self.word("HAVING"):
                q.having.append(self.primary())
                while self.peek()[1] == "(":
                    q.having.append(self.primary())
            elif self.word("ORDER"):
                self.need("BY")
                while True:
                    if way := self.word("DESC", "ASC"):
                        q.order.append((self.primary(), way == "ASC"))
                    elif self.peek()[0] == "var":
                        q.order.append((("term", self.term()), True))
                    else:
                        break
            elif self.word("LIMIT"):
                q.limit = int(self.next()[1])
            elif self.word("OFFSET"):
                q.offset = int(self.next()[1])
            elif self.peek()[0] == "end" or self.peek()[1] == "}":
                return q
            else:
                raise SparqlError(f"unexpected {self.peek()[1]!r}")


def c(name: str) -> Column:
    return F.col(f"`{name}`")


def number(x: Column) -> Column:
    return x.try_cast("double")


def numeric(e: tuple) -> bool:
    """Whether an expression is a number by how it is written."""
    return e[0] in ("+", "-", "*", "/") or (e[0] == "term" and e[1].number) or (e[0] == "call" and e[1] in ("STRLEN", "ABS"))


def expression(e: tuple, columns: list[str]) -> Column:
    """An expression's value: text for terms, boolean for tests, double for arithmetic."""
    op = e[0]
    if op == "term":
        if e[1].kind == "var":
            return c(e[1].value) if e[1].value in columns else F.lit(None).cast("string")
        return F.lit(e[1].value)
    if op in ("and", "or"):
        a, b = (expression(x, columns) for x in e[1:])
        return a & b if op == "and" else a | b
    if op == "not":
        return ~expression(e[1], columns)
    if op == "in":
        return expression(e[1], columns).isin(*[expression(x, columns) for x in e[2:]])
    if op in ("+", "-", "*", "/"):
        a, b = (number(expression(x, columns)) for x in e[1:])
        return {"+": a + b, "-": a - b, "*": a * b, "/": a / F.nullif(b, F.lit(0.0))}[op]
    if op in ("=", "!=", "<", ">", "<=", ">="):
        a, b = (expression(x, columns) for x in e[1:])
        test = lambda x, y: {"=": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
        if numeric(e[1]) or numeric(e[2]):  # what is no number has no place in their order, and is another value
            both = test(number(a), number(b))
            return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(both, F.lit(op == "!="))) if op in ("=", "!=") else both
        numbers = number(a).isNotNull() & number(b).isNotNull()
        return F.when(numbers, test(number(a), number(b))).otherwise(test(a.cast("string"), b.cast("string")))
    _, name, _, args = e
    kind = lambda x: c(x[1].value + "@") if x[0] == "term" and x[1].kind == "var" else F.lit("iri" if x[0] == "term" and x[1].kind == "iri" else "literal")
    a = [expression(x, columns) for x in args] if name not in ("ISIRI", "ISURI", "ISLITERAL", "ISBLANK", "BOUND") else []
    if name in ("ISIRI", "ISURI"):
        return kind(args[0]) == "iri"
    if name == "ISLITERAL":
        return kind(args[0]) == "literal"
    if name == "ISBLANK":
        return kind(args[0]) == "bnode"
    if name == "BOUND":
        return expression(args[0], columns).isNotNull()
    text = [x.cast("string") for x in a]
    calls = {
        "STR": lambda: text[0], "LCASE": lambda: F.lower(text[0]), "UCASE": lambda: F.upper(text[0]), "STRLEN": lambda: F.length(text[0]),
        "CONTAINS": lambda: F.contains(text[0], text[1]), "STRSTARTS": lambda: F.startswith(text[0], text[1]), "STRENDS": lambda: F.endswith(text[0], text[1]),
        "REGEX": lambda: F.regexp_like(text[0], F.concat(F.lit("(?i)"), text[1]) if len(text) > 2 else text[1]), "REPLACE": lambda: F.regexp_replace(text[0], text[1], text[2]),
        "CONCAT": lambda: F.concat(*text), "IF": lambda: F.when(a[0], text[1]).otherwise(text[2]), "COALESCE": lambda: F.coalesce(*text), "ABS": lambda: F.abs(number(a[0])), "LANG": lambda: F.lit(""),
    }
    if name not in calls:
        raise SparqlError(f"unknown function {name}")
    return calls[name]()


def variables(e) -> set[str]:
    """The variables of an expression."""
    if isinstance(e, Term):
        return {e.value} if e.kind == "var" else set()
    return set().union(*map(variables, e)) if isinstance(e, (tuple, list)) else set()


def lifted(e: tuple, found: list[tuple[str, tuple]]) -> tuple:
    """The expression with each aggregate in it as a variable, which ``found`` names."""
    if e[0] == "call" and e[1] in AGGREGATES:
        known = next((n for n, x in found if x == e), None)
        if known is None:
            known = f"_measure{len(found)}"
            found.append((known, e))
        return ("term", Term("var", known))
    if e[0] == "call":
        return (*e[:3], [lifted(x, found) for x in e[3]])
    return e if e[0] in ("term", "all") else (e[0], *[lifted(x, found) for x in e[1:]])


def aggregate(e: tuple, names: list[str]) -> Column:
    _, f, distinct, args = e
    x = F.lit(1) if args[0] == ("all",) else expression(args[0], names)
    if f == "COUNT":
        return F.count_distinct(x) if distinct else F.count(x)
    if f == "GROUP_CONCAT":  # in the order of the values, as SPARQL leaves it open
        texts = (F.collect_set if distinct else F.collect_list)(x.cast("string"))
        return F.array_join(F.array_sort(texts), args[1][1].value if len(args) > 1 else " ")
    if f == "SAMPLE":
        return F.min(x)
    if f in ("SUM", "AVG"):  # of the numbers among the values
        return {"SUM": F.sum_distinct if distinct else F.sum, "AVG": F.avg}[f](number(x))
    least, most = F.struct(number(x).isNull(), number(x), x), F.struct(number(x).isNotNull(), number(x), x)
    return F.min_by(x, F.when(x.isNotNull(), least)) if f == "MIN" else F.max_by(x, F.when(x.isNotNull(), most))


def shared_variables(a: DataFrame, b: DataFrame) -> list[str]:
    return [x for x in a.columns if x in b.columns and not x.endswith("@")]


def combined(a: Solutions, b: Solutions, how: str = "inner", filters: list[tuple] | None = None, minus: bool = False) -> Solutions:
    """Two sets of solutions joined on their common variables; those that may be unbound are compatible with any value."""
    (x, maybe), (y, other) = a, b
    keys = shared_variables(x, y)
    loose = [k for k in keys if k in maybe or k in other]
    new = {v for v in y.columns if v not in x.columns and not v.endswith("@")}
    left_open = frozenset((maybe - set(keys)) | (other - set(keys)) | (new if how == "left" else set()) | {k for k in loose if k in maybe and (k in other or how == "left")})
    after = maybe if how in ("left_semi", "left_anti") else left_open
    if not loose and not filters:
        y = y.drop(*[k + "@" for k in keys])
        return x.join(y, keys if keys else F.lit(True), how), after  # without a common variable: every combination, as SPARQL defines
    y = y.withColumnsRenamed({k + at: f"_right_{k}{at}" for k in keys for at in ("", "@")})
    right = lambda k: c(f"_right_{k}")
    tests = [c(k) == right(k) for k in keys if k not in loose]
    tests += [(c(k) == right(k)) | c(k).isNull() | right(k).isNull() for k in loose]
    if minus and len(loose) == len(keys):  # something must be in common
        tests.append(reduce(lambda p, q: p | q, [c(k).isNotNull() & right(k).isNotNull() for k in loose]))
    tests += [F.coalesce(expression(e, [*x.columns, *y.columns]), F.lit(False)) for e in filters or []]
    out = x.join(y, reduce(lambda p, q: p & q, tests), how)
    if how in ("left_semi", "left_anti"):
        return out, after
    out = out.withColumns({k + at: F.when(c(k).isNull(), right(k + at)).otherwise(c(k + at)) for k in loose for at in ("@", "")})
    return out.drop(*[f"_right_{k}{at}" for k in keys for at in ("", "@")]), after


def flat(g: Group) -> list[tuple]:
    """The triple patterns that all solutions of a group match."""
    out = [t for part in g.parts if part[0] == "triples" for t in part[1]]
    return out + [t for part in g.parts if part[0] == "graph" for t in flat(part[2])]


class Engine:
    """Queries over a DataFrame of quads (graph, s, p, o, o_kind and, if wanted, confidence)."""

    def __init__(self, quads: DataFrame, graph: str | None = None, services: dict[str, DataFrame] | None = None, most_keys: int = MOST_KEYS):
        """``services``: the quads of other stores by the address that SERVICE names."""
        self.quads, self.graph, self.services, self.most_keys = quads, graph, services or {}, most_keys
        self.spark = quads.sparkSession
        self.bound: dict[str, list[str]] = {}  # values of a variable outside, when this engine answers for another one

    def query(self, text: str) -> DataFrame:
        parser = Parser(text)
        q = parser.query()
        if parser.peek()[0] != "end":
            raise SparqlError(f"unexpected {parser.peek()[1]!r}")
        if q.form == "UPDATE":
            return self.update(q)
        if q.form == "DESCRIBE":
            return self.described(q)
        found = self.group(q.where, q.graph or self.graph)
        if q.form == "ASK":
            return found[0].limit(1).agg((F.count("*") > 0).alias("answer"))
        if q.form == "CONSTRUCT":
            return self.instances(found[0], q.template)
        return self.selected(found, q)

    def ask(self, text: str) -> bool:
        return self.query(text).first()["answer"]

    def described(self, q: Query) -> DataFrame:
        """The quads (s, p, o, o_kind) with a target as subject or object."""
        graph = q.graph or self.graph
        rows = (self.quads.where(F.col("graph") == graph) if graph else self.quads).select("s", "p", "o", "o_kind")
        names = [t.value for t in q.targets if t.kind != "var"]
        hit = F.col("s").isin(*names) | ((F.col("o_kind") != "literal") & F.col("o").isin(*names))
        out = rows.where(hit) if names else rows.limit(0)
        found = self.group(q.where, graph)[0] if q.where else None
        for v in [t.value for t in q.targets if t.kind == "var" and found is not None]:
            ids = found.select(c(v).alias("_x")).distinct()
            out = out.unionByName(rows.join(ids, F.col("s") == F.col("_x"), "left_semi"))
            out = out.unionByName(rows.where("o_kind <> 'literal'").join(ids, F.col("o") == F.col("_x"), "left_semi"))
        return out.distinct()

    def selected(self, solutions: Solutions, q: Query) -> DataFrame:
        found = solutions[0]
        names = [x for x in found.columns if not x.endswith("@")]
        measures: list[tuple[str, tuple]] = []
        select = [(n, e and lifted(e, measures)) for n, e in q.select]
        having, order = [lifted(e, measures) for e in q.having], [(lifted(e, measures), up) for e, up in q.order]
        if q.group_by or measures:
            made = [aggregate(e, names).alias(n) for n, e in measures]
            keys = [x for g in q.group_by for x in (g, g + "@") if x in found.columns]
            found = found.groupBy(*map(c, keys)).agg(*made) if made else found.select(*map(c, keys)).distinct()
            names = [x for x in found.columns if not x.endswith("@")]
        for e in having:
            found = found.where(expression(e, names))
        out = found.withColumns({n: expression(e, names) for n, e in select if e is not None}) if any(e for _, e in select) else found
        wanted = [n for n, _ in q.select] or [n for n in names if not n.startswith("_")]
        out = out.withColumns({n: F.lit(None).cast("string") for n in wanted if n not in out.columns})
        # numbers order as numbers, before text
        keys = [(k, up) for e, up in order for x in [expression(e, out.columns)] for k in (number(x), x.cast("string"))]
        out = out.withColumns({f"_order{i}": k for i, (k, _) in enumerate(keys)}) if keys else out
        sort = [F.col(f"_order{i}").asc_nulls_last() if up else F.col(f"_order{i}").desc_nulls_last() for i, (_, up) in enumerate(keys)]
        if q.distinct:  # before the order, which a later shuffle would lose
            first = [F.min(f"_order{i}").alias(f"_order{i}") for i in range(len(keys))]
            out = out.groupBy(*map(c, wanted)).agg(*first) if first else out.select(*map(c, wanted)).distinct()
        out = (out.orderBy(*sort) if sort else out).select(*map(c, wanted))
        out = out.offset(q.offset) if q.offset else out
        return out.limit(q.limit) if q.limit is not None else out

    def pattern(self, triple: tuple[Term, Term, Term], graph: Term | str | None) -> DataFrame:
        rows = self.quads
        at = [("s", triple[0]), ("p", triple[1]), ("o", triple[2])]
        if isinstance(graph, str):
            rows = rows.where(F.col("graph") == graph)
        elif graph is not None:
            at = [("graph", graph), *at]
        seen: dict[str, str] = {}
        for column, t in at:
            if t.kind != "var":
                rows = rows.where(F.col(column) == t.value)
                if column == "o":
                    rows = rows.where((F.col("o_kind") == "literal") == (t.kind == "literal"))
            elif t.value in seen:
                rows = rows.where(F.col(column) == F.col(seen[t.value]))
            else:
                seen[t.value] = column
                if t.value in self.bound:
                    rows = rows.where(F.col(column).isin(self.bound[t.value]))
        return rows.select(*[F.col(column).alias(v) for v, column in seen.items()], *[(F.col("o_kind") if column == "o" else F.lit("iri")).alias(v + "@") for v, column in seen.items()])

    def relation(self, path, graph, start: str | None = None) -> DataFrame:
        """(_s, _o, _o@) of a path, for ``start`` only where it is given."""
        rows = self.quads.where(F.col("graph") == graph) if isinstance(graph, str) else self.quads
        if isinstance(path, Term):
            rows = rows.where(F.col("p") == path.value)
            return (rows.where(F.col("s") == start) if start else rows).select(F.col("s").alias("_s"), F.col("o").alias("_o"), F.col("o_kind").alias("_o@"))
        what, inner = path
        if what == "inv":
            back = self.relation(inner, graph).where(c("_o@") != "literal").select(F.col("_o").alias("_s"), F.col("_s").alias("_o"), F.lit("iri").alias("_o@"))
            return back.where(F.col("_s") == start) if start else back
        if what == "not":
            ways = []
            for back in (False, True):
                barred = [t.value for t, b in inner if b == back]
                if barred:
                    other = rows.where(~F.col("p").isin(barred))
                    ends = other.select(F.col("s").alias("_s"), F.col("o").alias("_o"), F.col("o_kind").alias("_o@"))
                    if back:
                        ends = ends.where(c("_o@") != "literal").select(F.col("_o").alias("_s"), F.col("_s").alias("_o"), F.lit("iri").alias("_o@"))
                    ways.append(ends.where(F.col("_s") == start) if start else ends)
            return reduce(DataFrame.unionByName, ways)
        if what == "alt":
            return reduce(DataFrame.unionByName, [self.relation(x, graph, start) for x in inner])
        if what == "seq":
            out = self.relation(inner[0], graph, start)
            for x in inner[1:]:
                after = self.relation(x, graph).toDF("_m", "_o2", "_k2")
                out = out.where(c("_o@") != "literal").join(after, F.col("_o") == F.col("_m")).select("_s", F.col("_o2").alias("_o"), F.col("_k2").alias("_o@"))
            return out
        once = self.relation(inner, graph).distinct()
        own = once.where(F.col("_s") == start) if start else once
        if what != "opt":
            edges = cut(once.select(F.col("_s").alias("s"), F.struct(F.col("_o").alias("v"), c("_o@").alias("k")).alias("o")))

            def step(known: DataFrame, new: DataFrame) -> DataFrame:
                on = (F.col("o.v") == F.col("_m")) & (F.col("o.k") != "literal")
                return new.join(edges.select(F.col("s").alias("_m"), F.col("o").alias("_t")), on).select("s", F.col("_t").alias("o"))

            closed = fixpoint(edges.where(F.col("s") == start) if start else edges, step, ["s", "o"])
            own = closed.select(F.col("s").alias("_s"), F.col("o.v").alias("_o"), F.col("o.k").alias("_o@"))
        if what == "plus":
            return own
        if start:
            nodes = self.spark.range(1).select(F.lit(start).alias("_s"), F.lit("iri").alias("_k"))
        else:
            nodes = rows.select(F.explode(F.array(F.struct(F.col("s").alias("_s"), F.lit("iri").alias("_k")), F.struct(F.col("o").alias("_s"), F.col("o_kind").alias("_k")))).alias("x")).select("x.*").distinct()
        return own.unionByName(nodes.select("_s", F.col("_s").alias("_o"), F.col("_k").alias("_o@"))).distinct()

    def along(self, s: Term, path, o: Term, graph) -> Solutions:
        """Solutions of a property path; it starts from a constant end, where there is one."""
        if s.kind == "var" and o.kind == "iri":
            return self.along(o, ("inv", path), s, graph)
        rows = self.relation(path, graph, s.value if s.kind != "var" else None)
        rows = rows.withColumn("_s@", F.lit("iri"))
        if o.kind != "var":
            rows = rows.where((F.col("_o") == o.value) & ((c("_o@") == "literal") == (o.kind == "literal")))
        if s.kind == o.kind == "var" and s.value == o.value:
            rows, o = rows.where("_s = _o"), Term("iri", "")
        ends = [(x, t.value) for x, t in (("_s", s), ("_o", o)) if t.kind == "var"]
        return rows.select(*[c(x + k).alias(v + k) for x, v in ends for k in ("", "@")]), frozenset()

    def bgp(self, triples: list[tuple[Term, Term, Term]], graph) -> Solutions:
        rest = sorted(triples, key=lambda t: (sum(x.kind == "var" for x in t), t[2].kind == "var"))
        out, have = None, set()
        while rest:
            near = next((t for t in rest if have & {x.value for x in t if x.kind == "var"}), rest[0])
            rest.remove(near)
            rows = self.pattern(near, graph), frozenset()
            out = rows if out is None else combined(out, rows)
            have |= {x.value for x in near if x.kind == "var"}
        return out

    def within(self, g: Group, graph, outside: list[str]) -> tuple[Solutions, list[tuple]]:
        """A group's solutions, and those of its filters that need variables from outside."""
        found, maybe = self.group(Group(parts=g.parts), graph)
        far = [e for e in g.filters if (variables(e) - set(found.columns)) & set(outside)]
        for e in g.filters:
            if e not in far:
                found = found.where(expression(e, found.columns))
        return (found, maybe), far

    def service(self, name: Term, silent: bool, g: Group, before: Solutions | None) -> Solutions | None:
        """The solutions of another store; if few values of a common variable are known, its scans read only those (a bind join)."""
        if name.value not in self.services:
            if silent:
                return None
            raise SparqlError(f"unknown service {name.value}")
        there = Engine(self.services[name.value], services=self.services, most_keys=self.most_keys)
        if before:
            common = sorted({t.value for triple in flat(g) for t in triple if isinstance(t, Term) and t.kind == "var"} & set(before[0].columns) - before[1])
            for v in common[:1]:
                keys = [r[0] for r in before[0].select(c(v)).distinct().limit(self.most_keys + 1).collect()]
                if len(keys) <= self.most_keys:
                    there.bound[v] = keys
        return there.group(g, None)

    def group(self, g: Group, graph) -> Solutions:
        triples: list = []
        out: Solutions | None = None

        def add(rows: Solutions) -> None:
            nonlocal out
            out = rows if out is None else combined(out, rows)

        for part in [*g.parts, ("end",)]:
            if part[0] == "triples":
                triples += part[1]
                continue
            if triples:
                add(self.bgp(triples, graph))
                triples = []
            what = part[0]
            if what == "graph":
                add(self.group(part[2], part[1].value if part[1].kind == "iri" else part[1]))
            elif what == "path":
                add(self.along(*part[1:], graph))
            elif what == "service":
                rows = self.service(*part[1:], out)
                if rows:
                    add(rows)
            elif what == "select":
                q = part[1]
                bound, self.bound = self.bound, {}  # measures are over all its rows
                rows = self.selected(self.group(q.where, q.graph or graph), q)
                self.bound = bound
                names = rows.columns
                kinds = {n + "@": F.lit("literal") if any(m == n and e for m, e in q.select) else F.when(c(n).rlike(IRI_LIKE), "iri").otherwise("literal") for n in names}
                add((rows.withColumns({n: c(n).cast("string") for n in names} | kinds), frozenset(names)))
            elif what == "optional":
                out = out or (self.spark.range(1).select(), frozenset())
                rows, far = self.within(part[1], graph, out[0].columns)
                out = combined(out, rows, "left", far)
            elif what == "union":
                branches = [self.group(b, graph) for b in part[1]]
                rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d for d, _ in branches])
                some = {v for v in rows.columns if any(v not in d.columns for d, _ in branches)}
                add((rows, frozenset(some).union(*[m for _, m in branches])))
            elif what == "values":
                _, names, rows = part
                data = [tuple(x for t in r for x in ((t.value, t.kind) if t else (None, None))) for r in rows]
                frame = self.spark.createDataFrame(data, ", ".join(f"`{n}` string, `{n}@` string" for n in names))
                add((frame, frozenset(n for i, n in enumerate(names) if any(r[i] is None for r in rows))))
            elif what in ("exists", "not_exists"):
                rows, far = self.within(part[1], graph, out[0].columns)
                out = combined(out, rows, "left_semi" if what == "exists" else "left_anti", far)
            elif what == "minus" and out is not None:
                rows = self.group(part[1], graph)
                if shared_variables(out[0], rows[0]):
                    out = combined(out, rows, "left_anti", minus=True)
            elif what == "bind":
                out = out or (self.spark.range(1).select(), frozenset())
                e = expression(part[2], out[0].columns)
                iri = part[2][0] == "term" and part[2][1].kind == "iri"
                out = out[0].withColumns({part[1]: e.cast("string"), part[1] + "@": F.lit("iri" if iri else "literal")}), out[1] | {part[1]}
        df, maybe = out or (self.spark.range(1).select(), frozenset())
        for e in g.filters:
            df = df.where(expression(e, df.columns))
        return df, maybe

    def instances(self, found: DataFrame, template: list[tuple[Term, Term, Term]]) -> DataFrame:
        """graph-less triples of the template for every solution; incomplete ones are left out."""
        value = lambda t: c(t.value) if t.kind == "var" else F.lit(t.value)
        kind = lambda t: c(t.value + "@") if t.kind == "var" else F.lit(t.kind)
        cells = F.array(*[F.struct(value(s).alias("s"), value(p).alias("p"), value(o).alias("o"), kind(o).alias("o_kind")) for s, p, o in template])
        return found.select(F.explode(cells).alias("t")).select("t.*").where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").distinct()

    def update(self, q: Query) -> DataFrame:
        """The quads after the update."""
        graph = q.graph or self.graph or "trusted"
        found = self.group(q.where, graph)[0] if q.where else self.spark.range(1).select()
        out = self.quads
        if q.delete:
            gone = self.instances(found, q.delete).select(F.lit(graph).alias("graph"), "s", "p", "o")
            out = out.join(gone, ["graph", "s", "p", "o"], "left_anti")
        if q.template:
            new = self.instances(found, q.template).select(F.lit(graph).alias("graph"), "*")
            new = new.join(out.select("graph", "s", "p", "o"), ["graph", "s", "p", "o"], "left_anti")
            extra = [F.lit(1.0).alias(x) if x == "confidence" else F.lit(None).cast(out.schema[x].dataType).alias(x) for x in out.columns if x not in new.columns]
            out = out.unionByName(new.select("*", *extra).select(*out.columns))
        return out.select(*self.quads.columns)
