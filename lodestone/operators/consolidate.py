"""Corroboration across sources, promotion, contradiction, and the passes that move triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.terms import iso

KEY = ("s", "p", "o")
MAX_NOISY = 0.999999


def normal_key(x) -> Column:
    return F.lower(F.trim(F.col(x)))


def noisy_or(claims: DataFrame, key: tuple[str, ...] = KEY, normalise: bool = True, once: DataFrame | None = None) -> DataFrame:
    """Per key: 1 - product(1 - best confidence of each source), rounded to six places, and the number of sources.

    A source counts once.  Both steps combine before their shuffle; with hot keys
    the second sees at most one row a source.  ``once``: more claims, of other sources, which state no key twice: these
    need no first step, so that they are combined by key where they are.
    """

    def keyed(rows: DataFrame, *more) -> DataFrame:
        return rows.select(*[(normal_key(k) if normalise else F.col(k)).alias(k) for k in key], *more)

    best = keyed(claims, "source_iri", "confidence").groupBy(*key, "source_iri").agg(F.max("confidence").alias("c")).drop("source_iri")
    best = best if once is None else best.unionByName(keyed(once, F.col("confidence").alias("c")))
    out = best.groupBy(*key).agg(F.product(1 - F.col("c")).alias("miss"), F.count("*").alias("n_sources"))
    return out.select(*key, F.round(F.least(F.greatest(1 - F.col("miss"), F.lit(0.0)), F.lit(1.0)), 6).alias("final_confidence"), "n_sources")


def canonical_spelling(claims: DataFrame) -> DataFrame:
    """For each normalised key, the spelling of its most confident member; ties by text."""
    best = F.max_by(F.struct(*KEY), F.struct("confidence", *KEY))
    return claims.groupBy(*[normal_key(k).alias(f"k{k}") for k in KEY]).agg(best.alias("b")).select("ks", "kp", "ko", F.col("b.s").alias("s"), F.col("b.p").alias("p"), F.col("b.o").alias("o"))


def provenance(claims: DataFrame) -> DataFrame:
    """Per key the sorted distinct sources and their number."""
    sources = F.array_sort(F.collect_set("source_iri"))
    return claims.groupBy(*KEY).agg(sources.alias("sources")).withColumn("n_sources", F.size("sources").cast("long"))


def promotion_candidates(claims: DataFrame, tentative: float = 0.35, trusted: float = 0.75, once: DataFrame | None = None) -> DataFrame:
    """Tentative claims whose confidence over all sources reaches the trusted threshold; ``once`` as in ``noisy_or``."""
    rows = lambda d: d.where((F.col("confidence") >= tentative) & (F.col("confidence") < trusted))
    return noisy_or(rows(claims), once=None if once is None else rows(once)).where(F.col("final_confidence") >= trusted)


def promote(quads: DataFrame, candidates: DataFrame, move: bool = False) -> DataFrame:
    """The quads with candidates appended to the trusted graph once; with ``move`` they leave the tentative one."""
    new = candidates.select(F.lit("trusted").alias("graph"), *KEY, F.lit("literal").alias("o_kind"), F.col("final_confidence").alias("confidence"))
    known = quads.where("graph = 'trusted'").select(*KEY)
    rest = quads
    if move:
        rest = quads.where("graph <> 'tentative'").unionByName(quads.where("graph = 'tentative'").join(candidates.select(*KEY), list(KEY), "left_anti").select(*quads.columns))
    return rest.unionByName(new.join(known, list(KEY), "left_anti").select(*new.columns))


def dedup_by_confidence(triples: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """One row a normalised key: the most confident, ties by source; its own spelling stays.  Combines before the shuffle."""
    keys = [normal_key(k).alias(f"_{k}") for k in key]
    best = F.min_by(F.struct(*triples.columns), F.struct(-F.col("confidence"), "source_iri", *key)).alias("best")
    return triples.groupBy(*keys).agg(best).select("best.*")


def contradictions(triples: DataFrame, functional: list[str] | None = None) -> DataFrame:
    """s, p, n, objects: subjects with two objects or more of a functional predicate."""
    rows = triples.where(F.col("p").isin(*functional)) if functional else triples
    return rows.groupBy("s", "p").agg(F.array_sort(F.collect_set("o")).alias("objects")).where(F.size("objects") >= 2).withColumn("n", F.size("objects").cast("long"))


def penalise(triples: DataFrame, groups: DataFrame, penalty: float = 0.3, threshold: float = 0.75, default: float = 0.5) -> DataFrame:
    """Conflicting triples with confidence before and after, and whether they leave the trusted graph."""
    before = F.coalesce("confidence", F.lit(default))
    after = F.round(F.greatest(F.lit(0.0), before * (1 - penalty)), 7)
    return triples.join(groups.select("s", "p"), ["s", "p"], "left_semi").select("s", "p", "o", before.alias("before"), after.alias("after"), (after < threshold).alias("demoted"))


def settle_contradictions(quads: DataFrame, functional: list[str], penalty: float = 0.3, threshold: float = 0.75, at=None) -> tuple[DataFrame, DataFrame]:
    """(quads, events): conflicting trusted quads lose confidence, and those that fall below the threshold become tentative.

    A quad that is tentative already keeps its higher confidence.  events: s, p, o, before, after, demoted, detected_at (ISO
    text of ``at``, or of the query), one a conflicting quad.  Without functional predicates nothing is done.
    """
    trusted = quads.where("graph = 'trusted'")
    hit = penalise(trusted, contradictions(trusted, functional), penalty, threshold) if functional else penalise(trusted.limit(0), trusted.limit(0), penalty, threshold)
    events = hit.withColumn("detected_at", iso(at))
    judged = quads.join(hit.select(F.lit("trusted").alias("graph"), *KEY, "after", "demoted"), ["graph", *KEY], "left")
    graph = F.when(F.col("demoted"), "tentative").otherwise(F.col("graph")).alias("graph")
    moved = judged.select(graph, *KEY, "o_kind", F.coalesce("after", "confidence").alias("confidence"))
    best = moved.groupBy("graph", *KEY).agg(F.max_by("o_kind", F.struct("confidence", "o_kind")).alias("o_kind"), F.max("confidence").alias("confidence"))
    return best.select("graph", *KEY, "o_kind", "confidence"), events


def collect_garbage(tentative: DataFrame, cutoff: Column, prefix: str = "kc:internal/") -> tuple[DataFrame, DataFrame]:
    """(kept, archived): triples first seen before the cutoff, or never, go; bookkeeping predicates stay."""
    stale = (F.col("first_seen").isNull() | (F.col("first_seen") < cutoff)) & ~F.col("p").startswith(prefix)
    return tentative.where(~stale), tentative.where(stale)


def verify(triples: DataFrame, drop: float = 0.4, boost: float = 0.8) -> DataFrame:
    """action of each triple from columns supported, score: quarantine, boost or keep; with its new confidence."""
    action = F.when(~F.col("supported") | (F.col("score") < drop), "quarantine").when(F.col("score") >= boost, "boost").otherwise("keep")
    return triples.withColumn("action", action).withColumn("after", F.when(action == "boost", F.greatest("confidence", "score")).otherwise(F.col("confidence")))


def minimal_hitting_set(sets: list[frozenset[str]]) -> tuple[str, ...]:
    """The smallest set of names that has one of each set in it; of equally small ones the first by its sorted names.

    Branch and bound: the first bound is a greedy set, a branch takes one of the names of the set with the fewest, and it
    ends where the sets that are left need more than the bound (as many as are pairwise without a common name).
    """
    sets = [s for s in set(sets) if not any(o < s for o in sets)]  # what hits a part hits the whole
    greedy, left = [], sets
    while left:
        names = set().union(*left)
        best = min(names, key=lambda x: (-sum(x in s for s in left), x))
        greedy.append(best)
        left = [s for s in left if best not in s]
    found = (len(greedy), tuple(sorted(greedy)))

    def apart(rest: list[frozenset[str]]) -> int:
        n, used = 0, set()
        for s in sorted(rest, key=len):
            if not s & used:
                n, used = n + 1, used | s
        return n

    def go(chosen: tuple[str, ...], rest: list[frozenset[str]], barred: frozenset[str]) -> None:
        nonlocal found
        if not rest:
            found = min(found, (len(chosen), tuple(sorted(chosen))))
            return
        if len(chosen) + apart([s - barred for s in rest]) > found[0]:
            return
        pick = min((s - barred for s in rest), key=lambda s: (len(s), sorted(s)))
        for x in sorted(pick):
            go((*chosen, x), [s for s in rest if x not in s], barred)
            barred |= {x}  # sets with x have been tried
            if any(s <= barred for s in rest):
                return

    go((), sets, frozenset())
    return found[1]


def explain_conflicts(triples: DataFrame) -> DataFrame:
    """s, p, sources: for each conflict the smallest set of sources that states all its objects (ties by name), comma-joined.

    A source that states no object alone may be left out; sets of sources that several objects share reach a task once.
    An object without a source is left out.
    """
    import pandas as pd

    def smallest(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen = minimal_hitting_set([frozenset(x) for x in pdf["sources"]])
        return pd.DataFrame({"s": [pdf["s"].iloc[0]], "p": [pdf["p"].iloc[0]], "sources": [",".join(chosen)]})

    groups = contradictions(triples).select("s", "p")
    rows = triples.where("source_iri IS NOT NULL").join(groups, ["s", "p"], "left_semi")
    families = rows.groupBy("s", "p", "o").agg(F.array_sort(F.collect_set("source_iri")).alias("sources")).select("s", "p", "sources").distinct()
    return families.groupBy("s", "p").applyInPandas(smallest, "s string, p string, sources string")


def ensemble_merge(votes: DataFrame, agreement: float = 0.5) -> DataFrame:
    """s, p, o with the share of models that say so, where it is enough."""
    n = votes.agg(F.count_distinct("model").alias("_n"))
    share = votes.groupBy(*KEY).agg(F.count_distinct("model").alias("k")).crossJoin(F.broadcast(n))  # one row
    return share.select(*KEY, F.round(F.col("k") / F.col("_n"), 6).alias("confidence")).where(F.col("confidence") >= agreement)


def ensemble_disagreement(votes: DataFrame, agreement: float = 0.5) -> DataFrame:
    """s, p, n_values, values (most votes first) where no object has enough votes."""
    n = votes.agg(F.count_distinct("model").alias("_n"))
    by = votes.groupBy(*KEY).agg(F.count_distinct("model").alias("k"))
    values = F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "o")))
    out = by.groupBy("s", "p").agg(F.max("k").alias("top"), values.alias("v")).crossJoin(F.broadcast(n))
    return out.where(F.col("top") / F.col("_n") < agreement).select("s", "p", F.size("v").cast("long").alias("n_values"), F.array_join(F.transform("v", lambda x: x["o"]), "|").alias("values"))


def cost_capped(calls: DataFrame, cap: float, by: str = "batch") -> DataFrame:
    """Calls of each batch, in order of seq, until the cost before them reaches the cap."""
    w = Window.partitionBy(by).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return calls.withColumn("before", F.coalesce(F.sum("cost").over(w), F.lit(0.0))).where(F.col("before") < cap)
