"""Status, absence, arguments, coverage, dependencies, shapes, pages and retrieval on quads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.terms import cosine, local_name, short_hash
from ..plans.lineage import parts
from ..schema import STATUSES

# Which status may follow which; nothing leaves "deprecated".  Anything known may begin.
MOVES = {
    "observed": ["verified", "deprecated"],
    "extracted": ["verified", "disputed", "deprecated", "speculative"],
    "inferred": ["verified", "deprecated", "disputed"],
    "verified": ["deprecated", "disputed"],
    "deprecated": [],
    "normative": ["deprecated"],
    "predicted": ["observed", "deprecated", "disputed"],
    "disputed": ["verified", "deprecated"],
    "speculative": ["extracted", "deprecated", "disputed"],
}


def annotate_status(triples: DataFrame, status: Column) -> DataFrame:
    """Reified statuses of (subject, predicate) pairs: four quads for each, named by the pair's hash; objects do not matter."""
    node = F.concat(F.lit("kc:status/"), short_hash(F.concat_ws("|", "s", "p")))
    parts = (("rdf:type", F.lit("kc:StatusAnnotation")), ("kc:onSubject", F.col("s")), ("kc:onPredicate", F.col("p")), ("kc:status", status))
    cells = F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in parts])
    return triples.select(node.alias("s"), F.explode(cells).alias("x")).select("s", "x.p", "x.o").distinct()


def read_status(quads: DataFrame) -> DataFrame:
    """(s, p, status) back from the reified quads; a pair may have several."""
    pick = lambda p: F.max(F.when(F.col("p") == p, F.col("o")))
    statuses = F.collect_set(F.when(F.col("p") == "kc:status", F.col("o"))).alias("statuses")
    rows = quads.groupBy("s").agg(pick("kc:onSubject").alias("subject"), pick("kc:onPredicate").alias("predicate"), statuses)
    return rows.select(F.col("subject").alias("s"), F.col("predicate").alias("p"), F.explode("statuses").alias("status"))


def valid_moves(moves: DataFrame) -> DataFrame:
    """subject, from, to, valid; a null ``from`` is a beginning, an unknown status is never valid."""
    allowed = F.create_map(*[x for a, b in MOVES.items() for x in (F.lit(a), F.array(*map(F.lit, b)).cast("array<string>"))])
    follows = F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("from")), F.col("to")), F.lit(False))
    return moves.select("subject", "from", "to", F.coalesce(F.when(F.col("from").isNull(), F.col("to").isin(*STATUSES)).otherwise(follows), F.lit(False)).alias("valid"))


def absences(quads: DataFrame, rules: DataFrame) -> DataFrame:
    """(s, p): subjects of a class without a predicate that a rule (class, p) asks for."""
    typed = quads.where("p = 'rdf:type'").select("s", F.col("o").alias("class"))
    return typed.join(rules, "class").select("s", "p").join(quads.select("s", "p"), ["s", "p"], "left_anti")


def negative_records(missing: DataFrame, kind: str = "absent") -> DataFrame:
    node = F.concat(F.lit("kc:negative/"), short_hash(F.concat_ws("|", F.lit(kind), "s", "p")))
    cells = F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in (("rdf:type", F.lit("kc:NegativeFact")), ("kc:kind", F.lit(kind)), ("kc:onSubject", F.col("s")), ("kc:onPredicate", F.col("p")))])
    return missing.select(node.alias("s"), F.explode(cells).alias("x")).select("s", "x.p", "x.o")


def argument_records(arguments: DataFrame) -> DataFrame:
    """Quads of (claim, evidence array, objections array<struct<text, rebuttal>>)."""
    node = F.concat(F.lit("kc:argument/"), short_hash("claim"))
    objection = lambda t: F.concat(F.lit("kc:objection/"), short_hash(F.concat_ws("|", F.col("claim"), t)))
    q = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    own = F.array(q(node, "rdf:type", F.lit("kc:ArgumentRecord")), q(node, "kc:claim", F.col("claim")))
    evidence = F.transform("evidence", lambda e: q(node, "kc:evidence", e))
    objections = F.flatten(F.transform("objections", lambda x: F.array(q(node, "kc:hasObjection", objection(x["text"])), q(objection(x["text"]), "kc:text", x["text"]))))
    rebuttals = F.transform(F.filter("objections", lambda x: x["rebuttal"].isNotNull()), lambda x: q(objection(x["text"]), "kc:rebuttedBy", x["rebuttal"]))
    return arguments.select(F.explode(F.concat(own, evidence, objections, rebuttals)).alias("x")).select("x.*")


def unanswered(quads: DataFrame) -> DataFrame:
    """(record, claim, objection): objections that nothing rebuts."""
    pattern = lambda p, s, o: quads.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))
    rows = pattern("kc:claim", "record", "claim").join(pattern("kc:hasObjection", "record", "objection"), "record")
    return rows.join(pattern("kc:rebuttedBy", "objection", "x"), "objection", "left_anti").select("record", "claim", "objection")


def assumption_records(assumptions: DataFrame) -> DataFrame:
    """Quads of (fact, text, confidence)."""
    node = F.concat(F.lit("kc:assumption/"), short_hash(F.concat_ws("|", "fact", "text")))
    cells = F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in (("rdf:type", F.lit("kc:Assumption")), ("kc:about", F.col("fact")), ("kc:text", F.col("text")), ("kc:confidence", F.col("confidence").cast("string")))])
    return assumptions.select(node.alias("s"), F.explode(cells).alias("x")).select("s", "x.p", "x.o")


def assumptions_of(quads: DataFrame) -> DataFrame:
    pick = lambda p: F.max(F.when(F.col("p") == p, F.col("o")))
    rows = quads.groupBy("s").agg(pick("kc:about").alias("fact"), pick("kc:text").alias("text"), pick("kc:confidence").alias("confidence"))
    return rows.where("fact IS NOT NULL").select("fact", "text", "confidence")


def coverage(claims: DataFrame, conflicts: DataFrame, topic: str = "o") -> DataFrame:
    """topic, n_sources, mean_confidence, n_contradictions."""
    bad = conflicts.select("s", "p").distinct().withColumn("_bad", F.lit(1))
    rows = claims.join(bad, ["s", "p"], "left")
    return rows.groupBy(F.col(topic).alias("topic")).agg(F.count_distinct("source_iri").alias("n_sources"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.sum(F.coalesce("_bad", F.lit(0))).alias("n_contradictions"))


def coverage_map(claims: DataFrame, conflicts: DataFrame, topic: str = "o", at: str = "seen_at") -> DataFrame:
    """``coverage`` with the time of the latest claim of each topic."""
    last = claims.groupBy(F.col(topic).alias("topic")).agg(F.max(at).alias("latest"))
    return coverage(claims, conflicts, topic).join(last, "topic")


def lint_findings(violated: DataFrame, graph: str) -> DataFrame:
    """Quads (s, p, o) of findings, named by graph, subject and kind; violated: focus, shape, message."""
    node = F.concat(F.lit("kc:finding/"), short_hash(F.concat(F.lit(graph), "focus", "shape")))
    parts = (("rdf:type", F.lit("kc:LintFinding")), ("kc:findingType", F.col("shape")), ("kc:findingSubject", F.col("focus")), ("kc:findingMessage", F.col("message")), ("kc:findingGraph", F.lit(graph)))
    cells = F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in parts])
    return violated.select(node.alias("s"), F.explode(cells).alias("x")).select("s", "x.p", "x.o").distinct()


def score_snapshot(quads: DataFrame, violated: DataFrame, at: Column) -> DataFrame:
    """graph, score, recorded_at: the share of subjects of each graph that no finding names; one row a graph, for an append-only history."""
    bad = violated.select(F.col("focus").alias("s")).distinct().withColumn("_bad", F.lit(1))
    subjects = quads.select("graph", "s").distinct().join(bad, "s", "left")
    return subjects.groupBy("graph").agg(F.round(1 - F.sum(F.coalesce("_bad", F.lit(0))) / F.count("*"), 6).alias("score")).withColumn("recorded_at", at)


def score_changes(history: DataFrame) -> DataFrame:
    """graph, recorded_at, score, change: each snapshot against the one before it."""
    w = Window.partitionBy("graph").orderBy("recorded_at")
    return history.withColumn("change", F.round(F.col("score") - F.lag("score").over(w), 6)).select("graph", "recorded_at", "score", "change")


def comparison_table(quads: DataFrame, subjects: list[str]) -> DataFrame:
    """p and a column for each subject with its values: the page that compares them."""
    rows = quads.where(F.col("s").isin(*subjects)).groupBy("p", "s").agg(F.array_join(F.array_sort(F.collect_set("o")), ", ").alias("v"))
    return rows.groupBy("p").pivot("s", subjects).agg(F.first("v"))


def topic_survey(quads: DataFrame, topic: str = "rdf:type") -> DataFrame:
    """topic, n_subjects, n_facts: what a survey page of each class says first."""
    of = quads.where(F.col("p") == topic).select("s", F.col("o").alias("topic"))
    return quads.join(of, "s").groupBy("topic").agg(F.count_distinct("s").alias("n_subjects"), F.count("*").alias("n_facts"))


def exposition(metrics: DataFrame) -> DataFrame:
    """line: metrics (name, labels map, value) as text for a scraper."""
    pair = lambda k, v: F.concat(k, F.lit('="'), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    body = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: pair(e["key"], e["value"])), ",")
    return metrics.select(F.concat("name", F.when(F.size("labels") > 0, F.concat(F.lit("{"), body, F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string")).alias("line"))


def dependencies(triples: DataFrame) -> DataFrame:
    """artifact, dep_kind, dep_ref: three edges for each subject and what it was made from."""
    edges = F.array(*[F.struct(F.lit(k).alias("dep_kind"), F.col(c).alias("dep_ref")) for k, c in (("fragment", "fragment_key"), ("source", "source_iri"), ("predicate", "p"))])
    return triples.select(F.col("s").alias("artifact"), F.explode(edges).alias("e")).select("artifact", "e.*").distinct()


def dependents(deps: DataFrame, changed: DataFrame) -> DataFrame:
    """Artifacts that depend on a changed reference (dep_ref)."""
    return deps.join(changed.select("dep_ref").distinct(), "dep_ref", "left_semi").select("artifact").distinct()


def invalidated(deps: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dependencies left, events): artifacts of changed references lose their edges."""
    gone = dependents(deps, changed)
    return deps.join(gone, "artifact", "left_anti"), gone.select(F.lit("artifact_invalidated").alias("event_type"), F.to_json(F.struct("artifact")).alias("payload"))


def semantic_diff(old: DataFrame, new: DataFrame, key: tuple[str, ...] = ("s", "p", "o")) -> DataFrame:
    """Each triple with status added, removed or unchanged."""
    a = old.select(*key).distinct().withColumn("_a", F.lit(1))
    b = new.select(*key).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, list(key), "full_outer")
    return both.select(*key, F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("unchanged").alias("status"))


# shapes

SHAPES = "shape string, target string, path string, kind string, value string, message string"


def violations(quads: DataFrame, shapes: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """focus, path, shape, kind: for (shape, target class, path, kind, value) with kinds minCount, maxCount, datatype, minInclusive, maxInclusive, pattern, in.

    A shape costs one aggregation over the values of its path; focus nodes come from
    their class.  Numbers compare only where the text is one.
    """
    parts = []
    typed = quads.where("p = 'rdf:type'").select(F.col("s").alias("focus"), F.col("o").alias("class"))
    for shape, target, path, kind, value in shapes:
        focus = typed.where(F.col("class") == target).select("focus")
        values = quads.where(F.col("p") == path).select(F.col("s").alias("focus"), "o")
        if kind in ("minCount", "maxCount"):
            n = F.coalesce("n", F.lit(0))
            bad = focus.join(values.groupBy("focus").agg(F.count("*").alias("n")), "focus", "left").where(n < int(value) if kind == "minCount" else n > int(value))
        else:
            number = F.expr("try_cast(o as double)")
            test = {"datatype": number.isNull(), "minInclusive": number < float(value) if kind == "minInclusive" else None, "maxInclusive": number > float(value) if kind == "maxInclusive" else None, "pattern": ~F.col("o").rlike(value), "in": ~F.col("o").isin(*value.split("|"))}[kind]
            bad = focus.join(values, "focus").where(F.coalesce(test, F.lit(True)))
        parts.append(bad.select("focus", F.lit(path).alias("path"), F.lit(shape).alias("shape"), F.lit(kind).alias("kind")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shape_score(quads: DataFrame, found: DataFrame) -> DataFrame:
    """The share of typed subjects without a violation."""
    total = quads.where("p = 'rdf:type'").agg(F.count_distinct("s").alias("n"))
    bad = found.agg(F.count_distinct("focus").alias("b"))
    return total.crossJoin(bad).select(F.round(1 - F.col("b") / F.greatest("n", F.lit(1)), 6).alias("score"))  # one row each


def shape_penalty(quads: DataFrame, found: DataFrame, penalty: float = 0.15) -> DataFrame:
    bad = found.select(F.col("focus").alias("s")).distinct().withColumn("_bad", F.lit(1))
    n = parts(quads, quads.count(), 500_000)  # both sides are sorted
    return quads.repartition(n, "s").join(bad.repartition(n, "s"), "s", "left").withColumn("confidence", F.when(F.col("_bad").isNotNull(), F.round(F.greatest(F.lit(0.0), F.col("confidence") - penalty), 6)).otherwise(F.col("confidence"))).drop("_bad")


def skos_integrity(quads: DataFrame) -> DataFrame:
    """focus, rule: labels missing or doubled, disjoint labels and relations, as the SKOS reference states them."""
    pick = lambda p, o: quads.where(F.col("p") == p).select(F.col("s").alias("focus"), F.col("o").alias(o))
    concept = quads.where("p = 'rdf:type' AND o = 'skos:Concept'").select(F.col("s").alias("focus"))
    pref, alt = pick("skos:prefLabel", "label"), pick("skos:altLabel", "label")
    rule = lambda d, name: d.select("focus", F.lit(name).alias("rule")).distinct()
    both = pick("skos:related", "x").join(pick("skos:broader", "x"), ["focus", "x"], "left_semi")
    exact = pick("skos:exactMatch", "x").join(pick("skos:broadMatch", "x"), ["focus", "x"], "left_semi")
    scheme = quads.where("p = 'rdf:type' AND o = 'skos:ConceptScheme'").select(F.col("s").alias("focus"))
    out = rule(concept.join(pref, "focus", "left_anti"), "label")
    for d, name in ((pref.groupBy("focus").agg(F.count("*").alias("n")).where("n > 1"), "S14"), (pref.join(alt, ["focus", "label"], "left_semi"), "S13"), (both, "S27"), (exact, "S46"), (concept.join(scheme, "focus", "left_semi"), "S9")):
        out = out.unionByName(rule(d, name))
    return out


# pages and retrieval

def pages(quads: DataFrame) -> DataFrame:
    """s, page: a Markdown page for each subject."""
    lines = F.array_sort(F.collect_list(F.concat(F.lit("- **"), local_name("p"), F.lit("**: "), "o")))
    title = F.coalesce(F.max(F.when(F.col("p") == "rdfs:label", F.col("o"))), F.first(local_name("s")))
    return quads.groupBy("s").agg(F.concat(F.lit("# "), title, F.lit("\n\n"), F.array_join(lines, "\n")).alias("page"))


def json_text(x: Column | str) -> Column:
    """A string as JSON."""
    j = F.to_json(F.array(x))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def json_ld(quads: DataFrame) -> DataFrame:
    """s, doc: JSON-LD; a predicate with several values has a list of them."""
    one = quads.groupBy("s", "p").agg(F.array_sort(F.collect_list("o")).alias("v"))
    value = F.when(F.size("v") == 1, json_text(F.col("v")[0])).otherwise(F.to_json("v"))
    body = F.array_join(F.array_sort(F.collect_list(F.concat(json_text("p"), F.lit(":"), value))), ",")
    return one.groupBy("s").agg(body.alias("body")).select("s", F.concat(F.lit('{"@id":'), json_text("s"), F.lit(","), "body", F.lit("}")).alias("doc"))


def html_pages(quads: DataFrame) -> DataFrame:
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    rows = F.array_sort(F.collect_list(F.concat(F.lit("<dt>"), esc(local_name("p")), F.lit("</dt><dd>"), esc(F.col("o")), F.lit("</dd>"))))
    return quads.groupBy("s").agg(F.concat(F.lit("<article><h1>"), F.first(esc(local_name("s"))), F.lit("</h1><dl>"), F.array_join(rows, ""), F.lit("</dl></article>")).alias("page"))


def page_sources(quads: DataFrame, most: int = 20) -> DataFrame:
    """page, fact: at most so many source facts of a page, by text."""
    facts = F.slice(F.array_sort(F.collect_set(F.concat_ws("|", "s", "p", "o"))), 1, most)
    return quads.groupBy("s").agg(facts.alias("f")).select(F.concat(F.lit("kc:page/"), local_name("s")).alias("page"), F.explode("f").alias("fact"))


def stale_pages(sources: DataFrame, changed: DataFrame) -> DataFrame:
    return sources.join(changed.select("fact").distinct(), "fact", "left_semi").select("page").distinct()


def top_similar(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", vector: str = "v") -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(id_col).alias("id"), F.round(cosine(vector, q), 6).alias("sim")).orderBy(F.desc("sim"), "id").limit(k)


def thesaurus(quads: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, term): labels of concepts that a seed label names, and of related or matching ones."""
    label = quads.where(F.col("p").isin("skos:prefLabel", "skos:altLabel")).select(F.col("s").alias("c"), F.col("o").alias("term"))
    named = seeds.join(label.withColumnRenamed("term", "seed"), "seed")
    link = quads.where(F.col("p").isin("skos:related", "skos:exactMatch", "skos:closeMatch")).select(F.col("s").alias("c"), F.col("o").alias("d"))
    near = named.join(link, "c").select("seed", F.col("d").alias("c"))
    return named.unionByName(near.select(*named.columns)).join(label, "c").select("seed", "term").distinct()


def latest(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Keyed upsert: the last row of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc(seq))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def known_context(facts: DataFrame, labels: DataFrame, tokens: DataFrame, least: int = 3) -> DataFrame:
    """(token, s): subjects whose label contains a token of a text; equal words first find the candidates."""
    words = labels.select("s", "label", F.explode(F.array_distinct(F.split(F.lower("label"), "[^a-z0-9#_]+"))).alias("token"))
    return words.where(F.length("token") >= least).join(tokens.select("token").distinct(), "token", "left_semi").select("token", "s").distinct()
