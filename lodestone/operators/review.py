"""Human review: tasks out, annotated tasks in, decisions, and the facts that these settle (QP-23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DATA = "fragment_iri string, artifact_iri string, subject string, predicate string, object_value string, confidence double, excerpt string, priority double"
#: An annotated task as labelling tools export it; other fields are not read.
TASK = (
    f"id long, data struct<{DATA.replace(' string', ': string').replace(' double', ': double')}>, "
    "annotations array<struct<result: array<struct<from_name: string, value: struct<choices: array<string>, text: array<string>>>>>>"
)
GRAPH = "human-review"


def tasks(queue: DataFrame) -> DataFrame:
    """value: one JSON task for each row of a review queue, pre-labelled with what was extracted; columns that are missing are left out."""
    names = [x.split(" ")[0] for x in DATA.split(", ")]
    return queue.select(F.to_json(F.struct(F.struct(*[F.col(c) for c in names if c in queue.columns]).alias("data"))).alias("value"))


def parsed(exported: DataFrame, value: str = "value") -> DataFrame:
    """id, data, annotations of tasks that are JSON texts, one each; texts that are no task give no row."""
    task = F.from_json(value, TASK)
    return exported.select(task.alias("t")).where("t.data IS NOT NULL").select("t.*")


def read_tasks(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The same from files with an array of tasks each, or with one task a line (``lines``: large files are split)."""
    return spark.read.schema(TASK).option("multiLine", not lines).json(path).where("data IS NOT NULL")


def decisions(labelled: DataFrame) -> DataFrame:
    """task_id, artifact_iri, subject, predicate, object_value, accepted, corrected, reviewer_note by the first annotation of a task.

    Without a decision a task is accepted; of several answers to one field the last that says something counts.
    Tasks without annotations are not decided.  A correction that changes nothing is none (and no acceptance).
    """
    result = F.coalesce(F.get("annotations", F.lit(0))["result"], F.array())

    def answer(field: str, kind: str, default: Column) -> Column:
        said = F.filter(result, lambda x: (x["from_name"] == field) & (F.size(x["value"][kind]) > 0))
        return F.coalesce(F.get(F.try_element_at(said, F.lit(-1))["value"][kind], F.lit(0)), default)

    was = F.coalesce("data.object_value", F.lit(""))
    rows = labelled.where(F.size("annotations") > 0).select(
        F.coalesce("id", F.lit(0)).alias("task_id"),
        *[F.coalesce(f"data.{c}", F.lit("")).alias(c) for c in ("artifact_iri", "subject", "predicate")],
        answer("object_value", "text", was).alias("object_value"),
        answer("decision", "choices", F.lit("accept")).alias("_decision"),
        answer("note", "text", F.lit("")).alias("reviewer_note"),
        was.alias("_was"),
    )
    corrected = (F.col("_decision") == "correct") & (F.col("object_value") != F.col("_was"))
    out = rows.withColumns({"accepted": F.col("_decision") == "accept", "corrected": corrected})
    return out.select("task_id", "artifact_iri", "subject", "predicate", "object_value", "accepted", "corrected", "reviewer_note")


def statements(decided: DataFrame, graph: str = GRAPH) -> DataFrame:
    """graph, s, p, o, confidence: what was accepted or corrected, with full confidence, each once; what was rejected is not written."""
    kept = decided.where("accepted OR corrected")
    facts = kept.select(F.lit(graph).alias("graph"), F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object_value").alias("o"))
    return facts.distinct().withColumn("confidence", F.lit(1.0))


def outcomes(decided: DataFrame) -> DataFrame:
    """predicate, accepted, corrected, rejected: how many of each."""
    yes, changed = F.col("accepted"), F.col("corrected")
    counts = {"accepted": yes, "corrected": changed, "rejected": ~yes & ~changed}
    return decided.groupBy("predicate").agg(*[F.count_if(x).alias(name) for name, x in counts.items()])
