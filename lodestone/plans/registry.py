"""Extension points: functions by group and name.

A parser takes sources, a fragmenter documents, an extractor fragments; connectors make
sources, reviewers take and give review tables.  All work on whole DataFrames.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from importlib.metadata import entry_points

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import sparql
from ..operators import consolidate, graph, knowledge, text
from ..sources import files

GROUPS = ("parsers", "fragmenters", "extractors", "connectors", "reviewers")
_known: dict[str, dict[str, Callable]] = {g: {} for g in GROUPS}


def register(group: str, name: str, function: Callable) -> None:
    if group not in _known:
        raise KeyError(f"unknown group {group}")
    _known[group][name] = function


def get(group: str, name: str) -> Callable:
    try:
        return _known[group][name]
    except KeyError:
        raise KeyError(f"no {name} among {group}: {sorted(_known.get(group, ()))}") from None


def names(group: str) -> list[str]:
    return sorted(_known[group])


def load(group: str) -> list[str]:
    """Registers what installed packages offer as ``lodestone.<group>``."""
    for point in entry_points(group=f"lodestone.{group}"):
        register(group, point.name, point.load())
    return names(group)


for _name, _function in text.FRAGMENTERS.items():
    register("fragmenters", _name, _function)
register("parsers", "text", files.parse)
register("extractors", "rules", text.extract)
register("extractors", "nothing", text.nothing)
register("connectors", "files", files.discover)


#: SQL functions over views: name, parameters, what it returns, body.  Of ``kc_quads``: graph, s, p, o, o_kind, confidence;
#: of ``kc_claims``: s, p, o, source_iri; of ``kc_violations``: bundle, graph, focus, shape; of ``kc_duplicates``: a, b, label, similarity.
SQL_FUNCTIONS = (
    ("kc_local_name", "x STRING", "STRING", "regexp_replace(x, '^.*[/#:]', '')"),
    ("kc_route", "confidence DOUBLE", "STRING", "CASE WHEN confidence >= 0.75 THEN 'trusted' WHEN confidence >= 0.35 THEN 'tentative' ELSE 'discard' END"),
    ("kc_noisy_or", "xs ARRAY<DOUBLE>", "DOUBLE", "round(1 - aggregate(xs, 1D, (a, x) -> a * (1 - x)), 6)"),
    ("kc_trigrams", "x STRING", "ARRAY<STRING>", "array_distinct(transform(sequence(1, length(x) + 1), i -> substring(concat('  ', lower(x), ' '), i, 3)))"),
    ("kc_fuzzy_match", "a STRING, b STRING", "DOUBLE", "round(size(array_intersect(kc_trigrams(a), kc_trigrams(b))) / size(array_union(kc_trigrams(a), kc_trigrams(b))), 6)"),
    ("kc_facts", "subject STRING", "TABLE (p STRING, o STRING, confidence DOUBLE)", "SELECT p, o, confidence FROM kc_quads WHERE s = subject"),
    ("kc_describe", "subject STRING", "TABLE (s STRING, p STRING, o STRING)", "SELECT s, p, o FROM kc_quads WHERE s = subject OR (o = subject AND o_kind <> 'literal')"),
    ("kc_rag_context", "subject STRING", "TABLE (block STRING)", "SELECT array_join(array_sort(collect_list(concat('- ', kc_local_name(p), ': ', o))), '\\n') FROM kc_quads WHERE s = subject"),
    ("kc_contradictions", "predicate STRING", "TABLE (s STRING, objects ARRAY<STRING>)", "SELECT s, array_sort(collect_set(o)) FROM kc_quads WHERE p = predicate GROUP BY s HAVING count(DISTINCT o) > 1"),
    ("kc_suggest_sameas", "name STRING, most INT", "TABLE (s STRING, label STRING, distance INT)", "SELECT s, o, levenshtein(lower(o), lower(name)) FROM kc_quads WHERE p = 'rdfs:label' AND levenshtein(lower(o), lower(name)) <= most"),
    (
        "kc_rag_retrieve", "question STRING, of_graph STRING, most INT", "TABLE (s STRING, p STRING, o STRING, score DOUBLE)",
        "SELECT s, p, o, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, s, p, o) AS n FROM (SELECT s, p, o, kc_fuzzy_match(concat_ws(' ', kc_local_name(s), kc_local_name(p), o), question) AS score FROM kc_quads WHERE graph = of_graph)) WHERE n <= most",
    ),
    (
        "kc_load_triples", "triples STRING, into STRING", "TABLE (graph STRING, s STRING, p STRING, o STRING, o_kind STRING, confidence DOUBLE)",
        "SELECT into, t.s, t.p, t.o, coalesce(t.o_kind, 'literal'), coalesce(t.confidence, 1D) FROM (SELECT explode(from_json(triples, 'array<struct<s:string,p:string,o:string,o_kind:string,confidence:double>>')) AS t) WHERE t.s IS NOT NULL AND t.p IS NOT NULL AND t.o IS NOT NULL",
    ),
    ("kc_load_shape_bundle", "name STRING", "TABLE (graph STRING, focus STRING, shape STRING)", "SELECT graph, focus, shape FROM kc_violations WHERE bundle = name"),
    (
        "kc_shacl_score", "of_graph STRING", "DOUBLE",
        "round(1 - (SELECT count(DISTINCT focus) FROM kc_violations WHERE graph = of_graph) / (SELECT count(DISTINCT s) FROM kc_quads WHERE graph = of_graph), 6)",
    ),
    (
        "kc_explain_contradiction", "entity STRING", "TABLE (p STRING, objects ARRAY<STRING>, sources ARRAY<STRING>)",
        "SELECT p, array_sort(collect_list(o)), kc_hitting_set(collect_list(named)) FROM (SELECT p, o, array_sort(collect_set(source_iri)) AS named FROM kc_claims WHERE s = entity AND source_iri IS NOT NULL GROUP BY p, o) GROUP BY p HAVING count(*) > 1",
    ),
    ("kc_pagerank_find_duplicates", "least DOUBLE", "TABLE (a STRING, b STRING, label STRING, similarity DOUBLE)", "SELECT a, b, label, similarity FROM kc_duplicates WHERE similarity >= least"),
)


def duplicates_by_rank(quads: DataFrame) -> DataFrame:
    """a, b, label, similarity of all nodes of one label that share a neighbour; the better ranked one first."""
    edges = quads.where("o_kind <> 'literal'").select(F.col("s").alias("a"), F.col("o").alias("b"))
    labels = quads.where("p = 'rdfs:label'").select(F.col("s").alias("iri"), F.col("o").alias("label"))
    return graph.rank_duplicates(graph.page_rank(edges), labels, edges, 0.0)


def register_sql(quads: DataFrame, claims: DataFrame | None = None, bundles: dict[str, list[tuple]] | None = None, ranks: bool = False) -> list[str]:
    """The views and the functions on them, for this session; plain SQL, so Catalyst plans through them.

    ``claims``: with source_iri, for explanations; ``bundles``: shapes (as of ``knowledge.violations``) by name; ``ranks``: whether to rank nodes now.
    What is not given is an empty view.
    """
    spark = quads.sparkSession
    quads.createOrReplaceTempView("kc_quads")
    (claims if claims is not None else spark.createDataFrame([], "s string, p string, o string, source_iri string")).createOrReplaceTempView("kc_claims")
    found = spark.createDataFrame([], "bundle string, graph string, focus string, shape string")
    for name, shapes in (bundles or {}).items():
        bad = knowledge.violations(quads, shapes).select("focus", "shape").distinct()
        where = quads.select("graph", F.col("s").alias("focus")).distinct()
        found = found.unionByName(bad.join(where, "focus").select(F.lit(name).alias("bundle"), "graph", "focus", "shape"))
    found.createOrReplaceTempView("kc_violations")
    (duplicates_by_rank(quads) if ranks else spark.createDataFrame([], "a string, b string, label string, similarity double")).createOrReplaceTempView("kc_duplicates")

    @F.pandas_udf("array<string>")
    def hitting(families: pd.Series) -> pd.Series:
        return pd.Series([list(consolidate.minimal_hitting_set([frozenset(s) for s in sets])) for sets in families])

    spark.udf.register("kc_hitting_set", hitting)
    for name, parameters, returns, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    return [f[0] for f in SQL_FUNCTIONS]


CALL = re.compile(r"kc_sparql\(\s*'((?:[^']|'')*)'\s*\)", re.I)


def sql(quads: DataFrame, text: str, **options) -> DataFrame:
    """SQL in which kc_sparql('...') stands for the solutions of a SPARQL query: it is compiled to a view, so both are planned as one."""
    engine = sparql.Engine(quads, **options)

    def view(m: re.Match) -> str:
        name = f"kc_sparql_{uuid.uuid4().hex}"
        engine.query(m[1].replace("''", "'")).createOrReplaceTempView(name)
        return name

    return quads.sparkSession.sql(CALL.sub(view, text))
