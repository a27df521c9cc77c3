"""Vocabulary normalisation: categorical values, canonical names, qualified facts, rewrites."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.similarity import similar
from ..functions.terms import camel_case, decode_escape, local_name, namespace
from ..plans.lineage import hot_join

VOCAB = "http://kc.example/vocab/"

# What a predicate's local name may carry, tried in this order, and the predicate that states it.
ORDINALS = "first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth"
QUALIFIERS = (
    (r"(?i:_in_)(\d{4})$", "ex:year"),
    (r"_(\d{4})$", "ex:year"),
    (r"(?i:_on_)(\d{1,2}_\w+|\w+_\d{1,2})$", "ex:date"),
    (rf"_((?i:{ORDINALS}))$", "ex:ordinal"),
    (r"_(\d+(?i:st|nd|rd|th))$", "ex:ordinal"),
    (rf"_((?i:{ORDINALS}))_", "ex:ordinal"),
    (r"_(\d+(?i:st|nd|rd|th))_", "ex:ordinal"),
    (r"_((?i:two|three|four|five|six|seven|eight|nine|ten))_", "ex:count"),
)


def categorical(quads: DataFrame, least: int = 2) -> DataFrame:
    """p, o, n: literals that a predicate has at least so often."""
    return quads.where("o_kind = 'literal'").groupBy("p", "o").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def promote_categorical(quads: DataFrame, least: int = 2) -> DataFrame:
    """The quads with such literals as concepts of the vocabulary."""
    literal = F.coalesce((F.col("o_kind") == "literal") & F.col("p").isNotNull() & F.col("o").isNotNull(), F.lit(False))
    found = categorical(quads.where(literal), 1).withColumnRenamed("n", "_n")
    both = hot_join(quads.where(literal), found, ["p", "o"], "_n", quads.where(literal).count()).unionByName(quads.where(~literal), allowMissingColumns=True)
    hit = F.coalesce(F.col("_n") >= least, F.lit(False))
    return both.select("graph", "s", "p", F.when(hit, F.concat(F.lit(VOCAB), camel_case("o"))).otherwise(F.col("o")).alias("o"), F.when(hit, "iri").otherwise(F.col("o_kind")).alias("o_kind"), "confidence")


def decompose(triples: DataFrame) -> DataFrame:
    """Facts with a qualifier in the local name of their predicate become a base fact and a qualifier fact.

    The first pattern that matches counts, at its leftmost place; the parts of the name
    around it are joined again.  Further columns stay; the qualifier's value is a literal.
    """
    local, space = F.col("_local"), F.col("_space")
    found = F.lit(None).cast("struct<before:string,value:string,after:string,p:string>")
    for pattern, name in reversed(QUALIFIERS):
        split = lambda i, x=pattern: F.regexp_extract(local, f"^(.*?)(?:{x})(.*)$", i)
        one = F.struct(split(1).alias("before"), split(2).alias("value"), split(3).alias("after"), F.lit(name).alias("p"))
        found = F.when(local.rlike(pattern), one).otherwise(found)
    before, after = F.col("_q.before"), F.col("_q.after")
    base = (
        F.when((before != "") & (after != ""), F.concat(before, F.lit("_"), after)).when(before != "", before)
        .when(after != "", F.regexp_replace(after, "^_+", "")).otherwise("predicate")
    )
    own = [x for x in triples.columns if x not in ("p", "o", "o_kind")]
    kind = [F.col("o_kind")] if "o_kind" in triples.columns else []
    fact = F.struct(*own, F.concat(space, base).alias("p"), F.col("o"), *kind)
    extra = F.struct(*own, F.col("_q.p").alias("p"), F.replace("_q.value", F.lit("_"), F.lit(" ")).alias("o"), *[F.lit("literal").alias("o_kind") for _ in kind])
    plain = F.struct(*own, F.col("p"), F.col("o"), *kind)
    rows = triples.withColumns({"_local": local_name("p"), "_space": namespace("p")}).withColumn("_q", found)
    return rows.select(F.explode_outer(F.when(F.col("_q").isNull(), F.array(plain)).otherwise(F.array(fact, extra))).alias("f")).select(*[F.col(f"f.{x}") for x in triples.columns])


def predicate_leaders(quads: DataFrame, least: float = 0.6) -> DataFrame:
    """iri, canonical: predicates whose local names are alike, by greedy leaders.

    In order of frequency (then name) each predicate that no leader has taken leads, and
    takes all later ones with a ratio of ``least`` or more.  Predicates are a vocabulary:
    their distinct names and counts are one small group, whatever the number of triples.
    """
    counts = quads.groupBy("p").agg(F.count("*").alias("n")).withColumn("local", local_name("p"))

    def lead(pdf):
        import pandas as pd

        order = pdf.sort_values(["n", "p"], ascending=[False, True]).reset_index(drop=True)
        rows, left = [], list(zip(order["p"], order["local"], strict=True))
        while left:
            (head, name), rest = left[0], left[1:]
            left = []
            for p, local in rest:
                if similar(name, local, least):
                    rows.append((p, head))
                else:
                    left.append((p, local))
        return pd.DataFrame(rows, columns=["iri", "canonical"])

    return counts.groupBy(F.lit("all")).applyInPandas(lead, "iri string, canonical string")


def collapse_predicates(quads: DataFrame, least: float = 0.6) -> DataFrame:
    """The quads with each predicate replaced by its leader."""
    return rewrite(quads, predicate_leaders(quads, least), ("p",))


def equivalent_properties(leaders: DataFrame) -> DataFrame:
    """(s, p, o): owl:equivalentProperty from each predicate to its leader."""
    return leaders.select(F.col("iri").alias("s"), F.lit("owl:equivalentProperty").alias("p"), F.col("canonical").alias("o"))


def rewrite(triples: DataFrame, mapping: DataFrame, columns: tuple[str, ...] = ("s", "o")) -> DataFrame:
    """Each column through mapping (iri, canonical); what it lacks stays.  The join is broadcast only if the optimizer finds it small."""
    out = triples
    for c in columns:
        m = mapping.select(F.col("iri").alias(c), F.col("canonical").alias("_to"))
        out = out.join(m, c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return out.select(*triples.columns)


def canonical_by_frequency(clusters: DataFrame, counts: DataFrame) -> DataFrame:
    """iri, canonical: of each cluster the most frequent member, then the shortest, then by text."""
    w = Window.partitionBy("cluster").orderBy(F.desc("n"), F.length("iri"), "iri").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return clusters.join(counts, "iri", "left").withColumn("n", F.coalesce("n", F.lit(0))).select("iri", F.first("iri").over(w).alias("canonical"))


def canonical_shortest(clusters: DataFrame) -> DataFrame:
    """iri, canonical: the shortest member, then by text."""
    best = clusters.groupBy("cluster").agg(F.min(F.struct(F.length("iri"), "iri")).alias("b")).select("cluster", F.col("b.iri").alias("canonical"))
    return clusters.join(best, "cluster").select("iri", "canonical")


def canonical_names(quads: DataFrame) -> DataFrame:
    """Local names in camel case, in their namespace."""
    return quads.withColumn("s", F.when(F.col("s").rlike("[_ ]"), F.concat(namespace("s"), camel_case(local_name("s")))).otherwise(F.col("s")))


def decode_names(quads: DataFrame) -> DataFrame:
    return quads.withColumns({c: decode_escape(c) for c in ("s", "p", "o")})


def normalise(quads: DataFrame, mapping: DataFrame | None = None, name_pass: bool = False, collapse: bool = True, split: bool = True, canonical_predicates: DataFrame | None = None) -> DataFrame:
    """The passes in their fixed order; the best confidence of equal quads stays.

    Escapes, categories, alike predicates, qualified predicates, names (off by default),
    canonical entities (with ``mapping``), canonical predicates (with a mapping, such as
    that of ``greedy.leaders`` over their embeddings).
    """
    passes: list[Callable[[DataFrame], DataFrame]] = [decode_names, promote_categorical]
    if collapse:
        passes.append(collapse_predicates)
    if split:
        passes.append(decompose)
    if name_pass:
        passes.append(canonical_names)
    if mapping is not None:
        passes.append(lambda q: rewrite(q, mapping))
    if canonical_predicates is not None:
        passes.append(lambda q: rewrite(q, canonical_predicates, ("p",)))
    out = quads
    for p in passes:
        out = out.transform(p)
    return out.groupBy("graph", "s", "p", "o", "o_kind").agg(F.max("confidence").alias("confidence"))


def same_as(clusters: DataFrame) -> DataFrame:
    """alias owl:sameAs canonical, with the similarity as confidence."""
    rows = clusters.select("canonical", F.explode("aliases").alias("alias"), "similarity")
    return rows.select(F.col("alias").alias("s"), F.lit("owl:sameAs").alias("p"), F.col("canonical").alias("o"), F.col("similarity").alias("confidence"))


def skos(entities: DataFrame) -> DataFrame:
    """Concepts with labels become triples: type, preferred, alternative labels, scope note."""
    fixed = F.array(F.struct(F.lit("rdf:type").alias("p"), F.lit("skos:Concept").alias("o")), F.struct(F.lit("skos:prefLabel").alias("p"), F.col("preferred_label").alias("o")))
    alternatives = F.transform("alternate_labels", lambda a: F.struct(F.lit("skos:altLabel").alias("p"), a.alias("o")))
    note = F.when(F.col("scope_note").isNotNull(), F.array(F.struct(F.lit("skos:scopeNote").alias("p"), F.col("scope_note").alias("o")))).otherwise(F.array().cast("array<struct<p:string,o:string>>"))
    return entities.select(F.col("concept_iri").alias("s"), F.explode(F.concat(fixed, alternatives, note)).alias("x"), "confidence").select("s", "x.p", "x.o", "confidence")
