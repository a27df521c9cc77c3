"""CONSTRUCT rules to a fixpoint, and competency questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .lineage import cut
from .sparql import Engine


def construct(quads: DataFrame, rules: list[str], into: str = "inferred", rounds: int = 1, confidence: float = 1.0) -> DataFrame:
    """New quads that the rules give, in graph ``into``; ``rounds`` applies them to their own results as well."""
    key = ["s", "p", "o"]
    all_, new = quads, None
    for _ in range(rounds):
        made = None
        for rule in rules:
            one = Engine(all_).query(rule)
            made = one if made is None else made.unionByName(one)
        fresh = cut(made.distinct().join(all_.select(*key), key, "left_anti").select(F.lit(into).alias("graph"), "s", "p", "o", "o_kind", F.lit(confidence).alias("confidence")))
        new = fresh if new is None else new.unionByName(fresh)
        if fresh.isEmpty():
            break
        all_ = all_.unionByName(fresh.select(*all_.columns))
    return new


def competency(quads: DataFrame, questions: list[tuple[str, str]]) -> DataFrame:
    """id, passed for ASK questions; one scan each, stopped at the first answer."""
    parts = [Engine(quads).query(q).select(F.lit(i).alias("id"), F.col("answer").alias("passed")) for i, q in questions]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def coverage(answers: DataFrame) -> DataFrame:
    return answers.agg(F.count("*").alias("n"), F.sum((~F.col("passed")).cast("int")).alias("unanswered"), F.round(F.avg(F.col("passed").cast("int")), 4).alias("coverage"))
