"""Scores against ground truth: alignment, matching, calibration, gaps, tuning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.terms import alnum, bare, evaluation_label, year
from ..functions.similarity import ratio_of, token_sort_ratio
from .similar import ratio_matches

EXACT, PARTIAL = 0.85, 0.5


def aligned(extracted: DataFrame, alignment: DataFrame) -> DataFrame:
    """Triples with the properties that their predicate may stand for; the table is small and broadcast by size."""
    return extracted.join(alignment, F.col("p") == F.col("predicate")).drop("predicate")


def object_score(a, b) -> Column:
    """1 for equal normalised text, 0.95 for an equal year, else 0."""
    same_year = (year(a) != "") & (year(a) == year(b))
    return F.when(alnum(a) == alnum(b), 1.0).when(same_year, 0.95).otherwise(0.0)


def matches(extracted: DataFrame, alignment: DataFrame, truth: DataFrame) -> DataFrame:
    """Each triple with match_type exact, partial or no_match: by its first statement with a score of 0.5 or more."""
    t = truth.select("pid", "s", F.col("o").alias("value"))
    both = aligned(extracted, alignment).join(t, ["pid", "s"], "left").withColumn("score", F.coalesce(object_score("o", "value"), F.lit(0.0)))
    w = Window.partitionBy("s", "p", "o").orderBy(F.desc(F.col("score") >= PARTIAL), "value")
    first = both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return first.withColumn("match_type", F.when(F.col("score") >= EXACT, "exact").when(F.col("score") >= PARTIAL, "partial").otherwise("no_match"))


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 4)


def prf(tp: Column, n_extracted: Column, n_truth: Column) -> list[Column]:
    return [ratio_or_zero(tp, n_extracted).alias("precision"), ratio_or_zero(tp, n_truth).alias("recall"), ratio_or_zero(2 * tp, n_extracted + n_truth).alias("f1")]


def exact_prf(extracted: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of (s, p, o) multisets, equal after normalisation."""
    key = [*(by or []), "s", "p", "o"]
    norm = lambda d, n: d.select(*(by or []), "s", "p", bare("o").alias("o")).groupBy(*key).agg(F.count("*").alias(n))
    both = norm(extracted, "a").join(norm(truth, "b"), key, "full_outer").fillna(0, ["a", "b"])
    tp, a, b = F.sum(F.least("a", "b")), F.sum("a"), F.sum("b")
    return both.groupBy(*(by or [])).agg(tp.alias("tp"), *prf(tp, a, b))


def fuzzy_pairs(extracted: DataFrame, truth: DataFrame, least: float = 0.9) -> DataFrame:
    """Greedy one-to-one matches within (s, p): equal objects first, then by falling score, then by text.

    Both sides meet in one grouping, and Python gets many (s, p) in a batch, only those that both sides have.
    """

    def matched(xs: list, ys: list) -> list:
        scores = sorted((-n, x, y, i, j) for i, x in enumerate(xs) for j, y in enumerate(ys) if (n := 1.0 if x == y else ratio_of(x, y)) >= least)
        left, right, out = set(), set(), []
        for score, x, y, i, j in scores:
            if i not in left and j not in right:
                left.add(i), right.add(j)
                out.append((x, y, -score))
        return out

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            s, p, xs, ys = (batch.column(i).to_pylist() for i in range(4))
            found = [(a, b, *m) for a, b, x, y in zip(s, p, xs, ys, strict=True) for m in matched([v["o"] for v in x], [v["o"] for v in y])]
            cells = zip(*found, strict=True) if found else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, [pa.string()] * 4 + [pa.float64()], strict=True)], names=["s", "p", "o", "truth", "score"])

    norm = lambda d, left: d.select("s", "p", F.struct(bare("o").alias("o")).alias("o"), F.lit(left).alias("left"))
    side = lambda test: F.collect_list(F.when(test, F.col("o")))
    both = norm(extracted, True).unionByName(norm(truth, False)).groupBy("s", "p").agg(side(F.col("left")).alias("x"), side(~F.col("left")).alias("y"))
    return both.where("size(x) > 0 AND size(y) > 0").mapInArrow(run, "s string, p string, o string, truth string, score double")


def bucket(confidence) -> Column:
    c = F.col(confidence)
    return F.when(c < 0.25, "0.00-0.25").when(c < 0.5, "0.25-0.50").when(c < 0.75, "0.50-0.75").otherwise("0.75-1.00")


def calibration(found: DataFrame) -> DataFrame:
    """bucket, n, accuracy."""
    hit = (F.col("match_type") != "no_match").cast("int")
    return found.groupBy(bucket("confidence").alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(hit), 4).alias("accuracy"))


def pearson(curve: DataFrame) -> DataFrame:
    """Correlation of bucket midpoints and accuracies; 0 where it is undefined."""
    mid = F.substring("bucket", 1, 4).cast("double") + 0.125
    r = F.when(F.count("*") < 2, 0.0).otherwise(F.coalesce(F.nanvl(F.corr(mid, "accuracy"), F.lit(0.0)), F.lit(0.0)))
    return curve.agg(F.round(r, 4).alias("r"))


def totals(found: DataFrame, n_truth: DataFrame) -> DataFrame:
    """n, tp, fp (novel ones included), fn, false_positive_rate, novel_rate."""
    hit = F.sum((F.col("match_type") != "no_match").cast("int"))
    one = found.agg(F.count("*").alias("n"), hit.alias("tp")).crossJoin(n_truth.agg(F.count("*").alias("m")))  # one row each
    return one.select("n", "tp", (F.col("n") - F.col("tp")).alias("fp"), (F.col("m") - F.col("tp")).alias("fn"), ratio_or_zero(F.col("n") - F.col("tp"), F.col("n")).alias("false_positive_rate"))


def by_domain(found: DataFrame) -> DataFrame:
    return found.groupBy("domain").agg(F.count("*").alias("n"), F.round(F.avg((F.col("match_type") != "no_match").cast("int")), 4).alias("precision"))


def by_property(found: DataFrame, most: int = 30) -> DataFrame:
    rows = found.groupBy("pid").agg(F.count("*").alias("n"), F.round(F.avg((F.col("match_type") != "no_match").cast("int")), 4).alias("precision"))
    return rows.orderBy(F.desc("n"), "pid").limit(most)  # a report of the most frequent ones


def recall_by_property(found: DataFrame, truth: DataFrame) -> DataFrame:
    hit = found.where("match_type <> 'no_match'").select("pid", "s", "value").distinct().groupBy("pid").agg(F.count("*").alias("matched"))
    n = truth.groupBy("pid").agg(F.count("*").alias("n"))
    return n.join(hit, "pid", "left").select("pid", "n", F.coalesce("matched", F.lit(0)).alias("matched"), ratio_or_zero(F.coalesce("matched", F.lit(0)), F.col("n")).alias("recall"))


def recall_gaps(recall: DataFrame, below: float = 0.5) -> DataFrame:
    return recall.where(F.col("recall") < below)


def patterns(props: DataFrame, least: int = 2) -> DataFrame:
    """pid, fp, fn, lift: what a property misses or invents often enough."""
    fp = F.round((1 - F.col("precision")) * F.col("n")).cast("long")
    fn = (F.col("n") - F.round(F.col("precision") * F.col("n"))).cast("long")
    return props.select("pid", fp.alias("fp"), fn.alias("fn"), F.round(F.least(F.lit(5.0), 0.3 * fn), 4).alias("lift")).where((F.col("fp") >= least) | (F.col("fn") >= least))


def total_lift(found: DataFrame, most: float = 0.15) -> DataFrame:
    return found.agg(F.round(F.least(F.lit(most), F.sum("lift") / 100), 6).alias("total_lift"))


#: How many patches of a kind a report has, and beyond how many missed properties it says so in general.
MOST_EXAMPLES, MOST_CONSTRAINTS, MANY_MISSED = 5, 3, 5


def prompt_patches(found: DataFrame, labels: DataFrame | None = None, least: int = 2) -> DataFrame:
    """rank, patch_type, target_section, pid, content, rationale, priority, estimated_impact for the ``patterns`` of an evaluation.

    Examples for the properties that are missed most come first, then constraints for those invented most (ties by pid),
    then, where more than five are missed, one instruction for all (pid is null).  labels: pid, label, addition (the text
    of an example, or null); a property without a label goes by its pid.
    """
    spark = found.sparkSession
    known = labels if labels is not None else spark.createDataFrame([], "pid string, label string, addition string")
    d = found.join(known.select("pid", "label", "addition"), "pid", "left").withColumn("label", F.coalesce("label", "pid"))

    def top(by: str, n: int) -> DataFrame:
        few = d.where(F.col(by) >= least).orderBy(F.desc(by), "pid").limit(n)  # a report, so one task has a few rows
        return few.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(by), "pid")))

    def patch(rows: DataFrame, kind: str, section: str, content, why, priority: str, impact) -> DataFrame:
        values = {"patch_type": F.lit(kind), "target_section": F.lit(section), "content": content, "rationale": why, "priority": F.lit(priority), "estimated_impact": impact}
        return rows.select("rank", "pid", *[x.alias(c) for c, x in values.items()])

    lift = F.format_string("%.1f", "lift")
    asked = F.coalesce("addition", F.format_string("Show in an example how %s (%s) is extracted.", "label", "pid"))
    examples = patch(top("fn", MOST_EXAMPLES), "add_example", "few_shot", asked, F.format_string("%s (%s) was missed %d times.", "pid", "label", "fn"), "high", F.concat(F.lit("+"), lift, F.lit("% recall")))
    limit = F.format_string("Extract %s only if its object is of the type that %s expects.", "label", "pid")
    constraints = patch(top("fp", MOST_CONSTRAINTS).withColumn("rank", F.col("rank") + MOST_EXAMPLES), "add_instruction", "system", limit, F.format_string("%s gave %d false positives.", "pid", "fp"), "medium", F.format_string("-%d false positives", "fp"))
    missed = d.where(F.col("fn") >= least).agg(F.count("*").alias("n")).where(F.col("n") > MANY_MISSED)
    missed = missed.withColumns({"rank": F.lit(MOST_EXAMPLES + MOST_CONSTRAINTS + 1), "pid": F.lit(None).cast("string")})
    general = patch(missed, "add_instruction", "system", F.lit("Extract each fact that the text states, dates, places and relations included; do not infer."), F.format_string("%d properties were missed.", "n"), "high", F.lit("Broad recall"))
    return examples.unionByName(constraints).unionByName(general)


def discovery_rate(annotations: DataFrame) -> DataFrame:
    good, bad = (F.sum((F.col("verdict") == v).cast("int")) for v in ("correct", "incorrect"))
    return annotations.agg(ratio_or_zero(good, good + bad).alias("rate"))


def resolved_entities(subjects: DataFrame, article: tuple[str, str], candidates: DataFrame, least: float = 80.0) -> DataFrame:
    """iri, qid, match_type, confidence: the article's own item where the label is its title, else the best candidate by token-sorted ratio.

    subjects: iri, context (or null); candidates: label, qid, context.  A candidate of the subject's context gains 0.05.
    All candidates count, by an index that loses no ratio of ``least``; of equally good ones the first by qid.
    """
    title, qid = article
    named = subjects.select("iri", "context", evaluation_label("iri").alias("label"))
    same = F.lower(F.trim("label")) == F.lit(title.lower().strip())
    own = named.where(same & F.lit(bool(qid))).select("iri", F.lit(qid).alias("qid"), F.lit("sitelink").alias("match_type"), F.lit(1.0).alias("confidence"))
    rest = named.where(~same if qid else F.lit(True))
    other = candidates.select(F.col("label").alias("other"), "qid", F.col("context").alias("kind"))
    words = lambda c: F.array_join(F.array_sort(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")), " ")
    alike = ratio_matches(rest.select(words("label").alias("name")), other.select(words("other").alias("name")), least / 100 - 1e-6)
    rest, other = rest.withColumn("a", words("label")), other.withColumn("b", words("other"))
    scored = rest.join(alike, "a").join(other, "b").withColumn("ratio", F.round(100 * F.col("score"), 4)).where(F.col("ratio") >= least)
    best = F.min_by(F.struct("qid", "ratio", "kind", "context"), F.struct(-F.col("ratio"), F.col("qid"))).alias("b")
    bonus = F.when(F.col("b.context") == F.col("b.kind"), 0.05).otherwise(0.0)
    kind = F.when(F.col("b.ratio") < 100, "fuzzy_label").otherwise("label")
    found = scored.groupBy("iri").agg(best).select("iri", "b.qid", kind.alias("match_type"), F.round(F.least(F.lit(1.0), F.col("b.ratio") / 100 + bonus), 6).alias("confidence"))
    return own.unionByName(found)


def context_coverage(answers: DataFrame) -> DataFrame:
    """n, answered, coverage: the share of questions (question, context) for which there is any context."""
    has = F.count_if(F.length(F.trim(F.coalesce("context", F.lit("")))) > 0)
    return answers.agg(F.count("*").alias("n"), has.alias("answered"), F.round(has / F.count("*"), 6).alias("coverage"))
