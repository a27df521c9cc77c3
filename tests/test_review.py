"""Review decisions by hand cases of an export; prompt patches; YAML files that are parsed where they are read."""

import json

from lodestone.operators import evaluate, review
from lodestone.sources import files


def task(i, results, value="a", **data):
    return {"id": i, "data": {"subject": "s", "predicate": "p", "object_value": value, **data}, "annotations": [{"result": r} for r in results]}


def choice(x):
    return {"from_name": "decision", "type": "choices", "value": {"choices": x}}


def text(field, *x):
    return {"from_name": field, "value": {"text": list(x)}}


TASKS = [
    task(1, [[choice(["accept"])]]),
    task(2, [[choice(["reject"]), text("note", "not so")]]),
    task(3, [[choice(["correct"]), text("object_value", "b")]]),
    task(4, [[choice(["correct"]), text("object_value", "a")]]),  # changes nothing
    task(5, []),
    task(6, [[]], artifact_iri="art:6"),  # no decision: accepted
    task(7, [[choice(["reject"])], [choice(["accept"])]]),  # the first annotation counts
    task(8, [[choice(["reject"]), choice([]), choice(["accept"])]], "z"),
    task(9, [[{"from_name": None, "value": None}, text("object_value")]], "y"),
    {"data": {"subject": "s"}, "annotations": [{"result": None}], "extra": {"x": 1}},
]
WANT = {
    (1, "", "s", "p", "a", True, False, ""), (2, "", "s", "p", "a", False, False, "not so"), (3, "", "s", "p", "b", False, True, ""), (4, "", "s", "p", "a", False, False, ""),
    (6, "art:6", "s", "p", "a", True, False, ""), (7, "", "s", "p", "a", False, False, ""), (8, "", "s", "p", "z", True, False, ""), (9, "", "s", "p", "y", True, False, ""), (0, "", "s", "", "", True, False, ""),
}


def test_decisions(spark, tmp_path):
    texts = [(json.dumps(t),) for t in TASKS] + [("no json",), (None,), ("{}",)]
    got = review.decisions(review.parsed(spark.createDataFrame(texts, "value string")))
    assert {tuple(r) for r in got.collect()} == WANT and got.count() == len(WANT)
    facts = {(r.s, r.p, r.o, r.confidence) for r in review.statements(got).collect()}
    assert facts == {("s", "p", "a", 1.0), ("s", "p", "b", 1.0), ("s", "p", "z", 1.0), ("s", "p", "y", 1.0), ("s", "", "", 1.0)}
    assert {tuple(r) for r in review.outcomes(got).collect()} == {("p", 4, 1, 3), ("", 1, 0, 0)}
    (tmp_path / "a.json").write_text(json.dumps(TASKS))
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, TASKS)))
    assert {tuple(r) for r in review.decisions(review.read_tasks(spark, str(tmp_path / "a.json"))).collect()} == WANT
    assert {tuple(r) for r in review.decisions(review.read_tasks(spark, str(tmp_path / "b.jsonl"), lines=True)).collect()} == WANT
    assert review.decisions(review.parsed(spark.createDataFrame([], "value string"))).count() == 0


def test_tasks_come_back(spark):
    queue = spark.createDataFrame([("art:1", "s", "p", "o", 0.5, 1)], "artifact_iri string, subject string, predicate string, object_value string, confidence double, other int")
    back = review.parsed(review.tasks(queue)).select("data.*").first()
    assert (back.artifact_iri, back.subject, back.object_value, back.confidence, back.excerpt) == ("art:1", "s", "o", 0.5, None)
    assert review.decisions(review.parsed(review.tasks(queue))).count() == 0


def test_prompt_patches(spark):
    rows = [(f"P{i}", fp, fn, 0.3 * fn) for i, (fp, fn) in enumerate([(9, 2), (0, 7), (3, 7), (1, 1), (5, 4), (2, 3), (0, 2), (0, 9)])]
    found = spark.createDataFrame(rows, "pid string, fp long, fn long, lift double")
    labels = spark.createDataFrame([("P7", "born", "Show births."), ("P0", "died", None)], "pid string, label string, addition string")
    got = {r.rank: r for r in evaluate.prompt_patches(found, labels).collect()}
    assert [got[i].pid for i in range(1, 10)] == ["P7", "P1", "P2", "P4", "P5", "P0", "P4", "P2", None]
    assert [got[i].patch_type for i in (1, 5, 6, 9)] == ["add_example", "add_example", "add_instruction", "add_instruction"]
    assert got[1].content == "Show births." and "died" in got[6].content and "P1" in got[2].content
    assert got[1].estimated_impact == "+2.7% recall" and got[6].estimated_impact == "-9 false positives" and "7 properties" in got[9].rationale
    few = evaluate.prompt_patches(found.where("pid IN ('P1', 'P3')")).collect()
    assert [(r.rank, r.pid) for r in few] == [(1, "P1")]
    assert evaluate.prompt_patches(found.limit(0)).count() == 0


def test_yaml_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("ground_truth:\n- source: doc:1\n  triples:\n  - {subject: a, predicate: p, object_value: 1879}\n  - {subject: b, confidence: 0.5}\n- source: doc:2\n")
    (tmp_path / "b.yaml").write_text("triples: [{subject: c, predicate: q, object_value: x, confidence: 1}]\n")
    (tmp_path / "c.yaml").write_text("a: [")
    (tmp_path / "d.yaml").write_text("")
    got = files.read_yaml_triples(spark, [str(tmp_path / f"{x}.yaml") for x in "abcd"])
    rows = sorted((str(r.source).rsplit("/")[-1], r.subject, r.predicate, r.object_value, r.confidence) for r in got.collect())
    assert rows == [("b.yaml", "c", "q", "x", 1.0), ("doc:1", "a", "p", "1879", 1.0), ("doc:1", "b", None, None, 0.5)]
