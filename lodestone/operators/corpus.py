"""Views of a whole corpus: hashed embeddings, clusters, entity mentions and catalogs, registry links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.similarity import token_sort_of, token_sort_ratio
from ..functions.terms import cosine

MENTION = r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b"


def mentions(fragments: DataFrame, pattern: str = MENTION) -> DataFrame:
    """source_iri, mention, label, char_start, char_end: capitalised phrases, each by its first place."""
    found = fragments.select("source_iri", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), 0))).alias("mention"))
    start = F.instr("text", F.col("mention")) - 1
    return found.select("source_iri", "mention", F.lit("PHRASE").alias("label"), start.alias("char_start"), (start + F.length("mention")).alias("char_end"))


def catalog(found: DataFrame, alias_score: float = 85, most: int = 50) -> DataFrame:
    """canonical, canonical_name, aliases, n: the 2 * ``most`` most frequent mentions in groups; ``most`` groups stay, in the order of their first mention.

    By falling number (then by text) each mention joins the first group whose first mention has a token-sorted score above
    ``alias_score``, or begins one.  The first mention is the canonical one; its name is a slug of it.  At most 2 * ``most`` rows are compared, in one task.
    """
    import pandas as pd

    top = found.groupBy("mention").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "mention").limit(2 * most)

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: list[list] = []
        for mention, n in pdf.sort_values(["n", "mention"], ascending=[False, True])[["mention", "n"]].itertuples(index=False):
            home = next((g for g in groups if token_sort_of(mention, g[0]) > alias_score), None)
            if home is None:
                groups.append([mention, [], n])
            else:
                home[1].append(mention)
                home[2] += n
        return pd.DataFrame([(g[0], g[1], g[2], i) for i, g in enumerate(groups[:most])], columns=["canonical", "aliases", "n", "place"])

    out = top.groupBy(F.lit("all")).applyInPandas(group, "canonical string, aliases array<string>, n long, place int")
    slug = F.regexp_replace(F.regexp_replace(F.lower("canonical"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return out.orderBy("place").select("canonical", F.when(slug == "", "entity").otherwise(slug).alias("canonical_name"), "aliases", "n")


def embedding(text: Column, dims: int = 64) -> Column:
    """Hashed counts of character trigrams, at unit length; null and empty texts give zeros."""
    let = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731 - a lambda's variable is worked out once, an expression in one for each item
    t = F.lower(F.coalesce(text, F.lit("")))
    grams = F.when(F.length(t) >= 3, F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.pmod(F.xxhash64(F.substring(t, i, F.lit(3))), F.lit(dims)).cast("int"))).otherwise(F.array().cast("array<int>"))
    counts = lambda g: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.size(F.filter(g, lambda x: x == k)).cast("double"))
    norm = lambda c: F.greatest(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
    return let(grams, lambda g: let(counts(g), lambda c: let(norm(c), lambda n: F.transform(c, lambda x: x / n))))


def clusters(docs: DataFrame, n_docs: int, least: int = 20, per_cluster: int = 15, dims: int = 64) -> DataFrame:
    """source_iri, cluster by k-means over hashed words (seed 42); small corpora are one cluster."""
    if n_docs < least:
        return docs.select("source_iri", F.lit(0).alias("cluster"))
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer

    rows = docs.select("source_iri", F.coalesce("text", F.lit("")).alias("text"))
    k = max(2, min(round(n_docs / per_cluster), rows.select("text").distinct().count()))  # no more centres than texts
    stages = [RegexTokenizer(inputCol="text", outputCol="w", pattern=r"\W+"), HashingTF(inputCol="w", outputCol="f", numFeatures=dims * 16), Normalizer(inputCol="f", outputCol="v"), KMeans(featuresCol="v", predictionCol="cluster", k=k, seed=42)]
    return Pipeline(stages=stages).fit(rows).transform(rows).select("source_iri", "cluster")


def linked(new: DataFrame, registry: DataFrame, least: float = 0.9) -> DataFrame:
    """iri, registered, similarity: for new entities the most similar one of their block in the registry, if close enough."""
    r = registry.select(F.col("iri").alias("registered"), F.col("v").alias("w"), "block")
    both = new.join(r, "block").select("iri", "registered", F.round(cosine("v", "w"), 6).alias("similarity")).where(F.col("similarity") >= least)
    w = Window.partitionBy("iri").orderBy(F.desc("similarity"), "registered")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def resolved(names: DataFrame, sure: float = 0.92, likely: float = 0.7, edit: float = 88) -> DataFrame:
    """a < b of one source that mean the same: cosine of ``sure``, or ``likely`` and enough sorted-token score."""
    a, b = names.alias("a"), names.alias("b")
    pairs = a.join(b, (F.col("a.source_iri") == F.col("b.source_iri")) & (F.col("a.name") < F.col("b.name")))
    scored = pairs.select(F.col("a.name").alias("a"), F.col("b.name").alias("b"), cosine("a.v", "b.v").alias("c")).distinct().where(F.col("c") >= likely)
    scored = scored.withColumn("edit", token_sort_ratio("a", "b"))
    good = scored.where((F.col("c") >= sure) | (F.col("edit") >= edit))
    return good.select("a", "b", F.round(F.when(F.col("c") >= sure, F.col("c")).otherwise((F.col("c") + F.col("edit") / 100) / 2), 6).alias("confidence"))
