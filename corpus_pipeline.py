"""From raw documents to packed training sequences, in five stages.

Every stage takes what its predecessor kept (``documents`` first) and all but the
last return the columns of that table:

language_id      documents without a language (null text, no letter) go, and those whose letters look
                 less like the language predicted than evenly spread n-grams do; a null lang is filled
near_dedup       one document of each near-duplicate group stays (five words, 0.8)
decontaminate    documents with a passage of ``benchmark`` go
secrets          spans found in a text become "[secret]"; the document stays
packing          token sequences, as described in ``lodestone.llm.pack``

Between stages the result is written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lodestone.llm import decontaminate, langid, neardup, pack, secrets
from lodestone.plans.lineage import release, remove, settled, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
OWN = ("doc_id", "text", "lang")  # columns that operators read by name


def carried(docs: DataFrame, apply: Callable[[DataFrame, tuple[str, ...]], DataFrame]) -> DataFrame:
    """apply(docs, its columns) with further columns out of the way of the operator's own names."""
    names = {c: c if c in OWN else f"_carried_{i}" for i, c in enumerate(docs.columns)}
    out = apply(docs.withColumnsRenamed(names), tuple(names.values()))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs.where(~langid.held_out()))
    out = carried(docs, lambda d, keep: filled(langid.predict(d, model, keep, with_fit=True).where("lang_pred <> 'und' AND fit >= 0")))
    return out.select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])


def filled(predicted: DataFrame) -> DataFrame:
    """A null lang becomes the predicted one."""
    return predicted.withColumn("lang", F.coalesce("lang", "lang_pred"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = neardup.groups(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    one = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))  # rows with the same id are one document
    named = docs.join(kept, "doc_id", "left_semi").withColumn("_one", one).where("_one = 1").drop("_one")
    return named.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)  # what near_dedup shuffled
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, benchmark)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = carried(docs, lambda d, keep: secrets.scan(d, keep, redact=True))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)  # what decontaminate shuffled
    return pack.pack(docs, cached_words=250_000)  # workers hold what earlier stages left as well


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("secrets", without_secrets),
    ("packing", packing),
]

#: SQL cannot tokenize, learn or pack; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, paths = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = settled(spark, lambda: table(stage(spark, docs, sf_dir), name), paths)  # noqa: B023
        for path in paths[:-1]:  # what this stage has read is not read again
            remove(spark, path)
        del paths[:-1]
    return STAGES[-1][1](spark, docs, sf_dir)
