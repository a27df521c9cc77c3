"""Filters on the way in: ingest gate, ontology, grounding, routing, incremental skips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.terms import col, local_name

TRUSTED, TENTATIVE = 0.75, 0.35


def gate_reason(text="text", heading=None, depth=None, lang="lang", least: int = 50, most: int = 8000, languages: tuple[str, ...] = ("en",), need_heading: bool = False, least_depth: int = 0) -> Column:
    """The first failing rule of a fragment, cheap ones first; null if it passes."""
    size = F.length(F.trim(F.coalesce(col(text), F.lit(""))))
    out = F.when(size < least, "too_short").when(size > most, "too_long")
    if need_heading and heading is not None:
        out = out.when(F.coalesce(F.size(col(heading)), F.lit(0)) == 0, "no_heading")
    if least_depth and depth is not None:
        out = out.when(col(depth) < least_depth, "too_shallow")
    if languages and lang is not None:
        out = out.when(~F.coalesce(col(lang).isin(*languages), F.lit(False)), "language")
    return out


def same_predicate(x) -> Column:
    return F.lower(local_name(x))


def ontology_filter(triples: DataFrame, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) by local name of the predicate; an empty list allows all."""
    if not allowed:
        return triples, triples.limit(0)
    names = F.lower(local_name("p")).isin(*sorted({a.rsplit("#", 1)[-1].rsplit("/", 1)[-1].rsplit(":", 1)[-1].lower() for a in allowed}))
    return triples.where(names), triples.where(~names)


def route(confidence="confidence", trusted: float = TRUSTED, tentative: float = TENTATIVE) -> Column:
    return F.when(col(confidence) >= trusted, "trusted").when(col(confidence) >= tentative, "tentative").otherwise("discard")


def verification_candidates(quads: DataFrame, below: float = TRUSTED) -> DataFrame:
    """All quads under the confidence; literals only without a language or in English, where a column ``lang`` tells."""
    rows = quads.where(F.col("confidence") < below)
    return rows.where("o_kind = 'iri' OR lang IS NULL OR lang = '' OR lower(lang) LIKE 'en%'") if "lang" in quads.columns else rows


def noise_section(key, noise: list[str]) -> Column:
    low = F.lower(col(key))
    return F.exists(F.array(*[F.lit(n.lower()) for n in noise]), lambda n: (low == n) | low.startswith(n))


def evidence_valid(start="char_start", end="char_end", excerpt="excerpt") -> Column:
    return F.coalesce((col(end) > col(start)) & (col(start) >= 0) & (F.trim(col(excerpt)) != ""), F.lit(False))


def repaired_end(start="char_start", end="char_end", excerpt="excerpt") -> Column:
    return F.when(col(end) > col(start), col(end)).otherwise(col(start) + F.greatest(F.lit(1), F.length(col(excerpt))))


def grounded(excerpt, text) -> Column:
    """The exact path of citation grounding: the excerpt occurs in the text."""
    return F.coalesce(F.instr(col(text), col(excerpt)) > 0, F.lit(False)) & (F.length(col(excerpt)) > 0)


def grounding(mentions: DataFrame, docs: DataFrame) -> DataFrame:
    """The mentions (source_iri, excerpt, ...) with ``grounded``: a text is joined once for all mentions of it and never copied."""
    columns = [F.col(c) for c in mentions.columns if c != "source_iri"]
    per = mentions.groupBy("source_iri").agg(F.collect_list(F.struct(*columns)).alias("m"))
    judged = F.transform("m", lambda x: F.struct(*[x[c].alias(c) for c in mentions.columns if c != "source_iri"], grounded(x["excerpt"], F.col("text")).alias("grounded")))
    both = per.join(docs.select("source_iri", "text"), "source_iri").select("source_iri", judged.alias("m"))
    return both.select("source_iri", F.explode_outer("m").alias("m")).select("source_iri", "m.*")  # never empty; a plain explode would search twice, for a filter on the size


def hash_status(fragments: DataFrame, prior: DataFrame, force: bool = False) -> DataFrame:
    """fragment_key, content_hash, status (new, changed, unchanged); ``prior`` has each key once, or a column ``at`` by which the last one counts."""
    last = F.max_by("content_hash", "at") if "at" in prior.columns else F.max("content_hash")
    old = prior.groupBy("fragment_key").agg(last.alias("_old"))
    both = fragments.select("fragment_key", "content_hash").join(old, "fragment_key", "left")
    same = F.lit(False) if force else F.col("content_hash") == F.col("_old")
    return both.select("fragment_key", "content_hash", F.when(F.col("_old").isNull(), "new").when(same, "unchanged").otherwise("changed").alias("status"))


def distil_strategy(text, least_triples: int = 50) -> Column:
    """How hard to distil: by the share of the text that gives ``least_triples`` at half a triple a kilobyte (fixed values)."""
    share = F.lit(least_triples / 0.5) / F.greatest(F.octet_length(col(text)) / 1024, F.lit(1.0))
    return F.when(share >= 1, "skip").when(share >= 0.60, "conservative").when(share >= 0.25, "moderate").otherwise("aggressive")


def skip_preprocessing(docs: DataFrame, fragments_of: DataFrame) -> DataFrame:
    """doc_id, skip: at most one fragment and under 2000 characters."""
    n = fragments_of.groupBy("source_iri").agg(F.count("*").alias("n"))
    return docs.join(n, "source_iri", "left").select("source_iri", ((F.coalesce("n", F.lit(0)) <= 1) & (F.length("text") < 2000)).alias("skip"))


def tenant_view(df: DataFrame, tenant: str | None) -> DataFrame:
    return df.where(F.col("tenant_id").isNull() | (F.col("tenant_id") == F.lit(tenant)))


def top_per_fragment(triples: DataFrame, most: int) -> DataFrame:
    """The most confident triples of each fragment, with the number that a fragment lost."""
    by = Window.partitionBy("source_iri", "fragment_key")
    ranked = triples.withColumn("_rank", F.row_number().over(by.orderBy(F.desc("confidence"), "s", "p", "o"))).withColumn("n_capped", F.greatest(F.lit(0), F.count("*").over(by) - most))
    return ranked.where(F.col("_rank") <= most).drop("_rank")
