"""Hand cases, offsets, and the sieves against a walk over plain lists."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from lodestone.operators import coreference as co

CASES = [
    ("Marie Curie was born in Warsaw. She won two prizes. Her work was noted.", "Marie Curie was born in Warsaw. Marie Curie won two prizes. Marie Curie's work was noted."),
    ("Marie Curie met Albert Einstein. She spoke. He left.", None),  # either may be meant
    ("Mrs Curie met Mr Einstein. She spoke. He left. Einstein saw her.", "Mrs Curie met Mr Einstein. Mrs Curie spoke. Mr Einstein left. Einstein saw Mrs Curie."),
    ("The Royal Society is old. It has a seat in London. Its library is large.", "The Royal Society is old. Royal Society has a seat in London. Its library is large."),
    ("Marie Curie and Pierre Curie worked. They won. Curie wrote.", "Marie Curie and Pierre Curie worked. Marie Curie and Pierre Curie won. Curie wrote."),
    ("Dr. J. K. Smith wrote. Bohr met him.", "Dr. J. K. Smith wrote. Bohr met J. K. Smith."),
    ("Marie Curie lectured. Scientists came. Curie left. She went home.", "Marie Curie lectured. Scientists came. Curie left. Marie Curie went home."),
    ("Einstein met him.", None),  # not himself
    ("The Royal Society met. It is known that all came. It rained.", None),
    ("Niels Bohr told us. One. Two. Three. He left.", None),  # beyond the reach
    ("IBM paid. He left.", None),
    ("Scientists met. They left and he stayed. It rained.", None),
    ("no names here. he left", None),
    ("", None),
    (None, None),
]


def plain(text, reach=2, passes=2):
    """(start, end, name) of what is replaced, by loops."""
    rows, at, sentence = [], 0, 0
    for m in regex.finditer(co._PIECE.replace(r"\z", r"\Z"), text):
        gap, word = m.groups()
        kind = "tail" if not word else "end" if word[0] in ".!?\n" else "pronoun" if word.lower() in co.PRONOUNS else "name"
        rows.append({"gap": gap, "m": word, "kind": kind, "at": at + len(gap), "sentence": sentence, "ref": None})
        at += len(gap) + len(word)
        sentence += kind == "end"
    titles = (*co.FEMALE, *co.MALE, *co.EITHER)
    names = [r for r in rows if r["kind"] == "name"]
    for r in names:
        first = r["m"].split(" ")[0].rstrip(".")
        r["title"] = first if first in titles and " " in r["m"] else ""
        r["bare"] = r["m"].split(" ", 1)[1] if r["title"] else r["m"]
    longs = {r["bare"] for r in names if " " in r["bare"]}
    for r in names:
        last = {x for x in longs if x.split(" ")[-1] == r["bare"].split(" ")[-1]}
        first = {x for x in longs if x.split(" ")[0] == r["bare"].split(" ")[0]}
        r["entity"] = r["bare"] if " " in r["bare"] else next(iter(last)) if len(last) == 1 else next(iter(first)) if len(first) == 1 else r["bare"]
    for i, r in enumerate(rows):
        if r["kind"] == "name":
            first = not r["gap"].strip() and (i == 0 or rows[i - 1]["kind"] == "end")
            r["sure"] = bool(r["title"]) or " " in r["bare"] or not first
    sure = {r["entity"] for r in names if r["sure"]}
    known = {}
    for r in names:
        if r["entity"] not in sure:
            continue
        r["shown"] = r["entity"] if " " in r["entity"] else max(x["m"] for x in names if x["entity"] == r["entity"])
        k = known.setdefault(r["shown"], set())
        k |= {"f"} if r["title"] in co.FEMALE else {"m"} if r["title"] in co.MALE else set()
        k |= {"person"} if r["title"] else set()
        if set(r["bare"].split(" ")) & set(co.THINGS) or regex.fullmatch(r"[\p{Lu} ]{2,}", r["bare"]) or regex.search(co.PLACE_BEFORE, r["gap"]):
            k.add("n")
    for i, r in enumerate(rows):
        if r["kind"] == "name" and i and rows[i - 1]["kind"] == "name" and r["gap"] == " and " and r.get("shown") and rows[i - 1].get("shown"):
            r["pair"] = f"{rows[i - 1]['shown']} and {r['shown']}"

    def fits(r, c):
        if c == "p":
            return r.get("pair") or (r["old"] if r["kind"] == "pronoun" and co.PRONOUNS[r["m"].lower()][0] == "p" else None)
        name = r.get("shown") or (r["old"] if r["kind"] == "pronoun" and co.PRONOUNS[r["m"].lower()][0] != "p" else None)
        k = known.get(name, set())
        if c == "n":
            return name if not k & {"f", "m", "person"} else None
        other = "m" if c == "f" else "f"
        return name if other not in k and ("n" not in k or k & {"person", c}) else None

    for _ in range(passes):
        for r in rows:
            r["old"] = r["ref"]
        for i, r in enumerate(rows):
            if r["kind"] != "pronoun":
                continue
            c, case = co.PRONOUNS[r["m"].lower()]
            after = rows[i + 1]["gap"] if i + 1 < len(rows) else ""
            if r["m"].lower() == "her" and not regex.search(co.OBJECT_NEXT, after):
                case = "owner"
            if r["m"].lower() == "it":
                case = "opens" if not r["gap"].strip() and (i == 0 or rows[i - 1]["kind"] == "end") and not regex.search(co.EMPTY_IT, after) else None
            r["case"] = case
            here = {x for q in rows[:i] if q["sentence"] == r["sentence"] and (x := fits(q, c))}
            earlier = set()
            for back in range(1, reach + 1):
                earlier = {x for q in rows if q["sentence"] == r["sentence"] - back and (x := fits(q, c))}
                if earlier:
                    break
            only = next(iter(earlier)) if len(earlier) == 1 else None
            if case is None or (case in ("opens", "object") and here and (case == "opens" or len(here) > 1)):
                r["ref"] = None
            elif case == "object" and here:
                r["ref"] = only if only not in here else None
            else:
                r["ref"] = only if not here else next(iter(here)) if len(here) == 1 else None
        for r in rows:
            if r["kind"] == "pronoun" and r["ref"]:
                known.setdefault(r["ref"], set()).add(co.PRONOUNS[r["m"].lower()][0])
    return [(r["at"], r["at"] + len(r["m"]), r["ref"]) for r in rows if r["kind"] == "pronoun" and r["ref"]]


def resolved(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return [tuple(x)[1:] for x in co.resolve(df, "rules").orderBy("id").collect()]


def test_hand_cases(spark):
    got = resolved(spark, [a for a, _ in CASES])
    assert [t for t, _ in got] == [a if b is None else b for a, b in CASES]
    for (before, _), (after, edits) in zip(CASES, got, strict=True):
        for e in edits:
            assert before[e.start : e.end] == e.pronoun and after[e.new_start : e.new_end].startswith(e.name)


def random_texts(n):
    r = random.Random(4)
    words = ["Marie Curie", "Curie", "Mrs Curie", "Mr Bohr", "Niels Bohr", "Bohr", "IBM", "Royal Society", "in Paris", "and", "he", "she", "her", "him", "his", "it", "its", "they", "their", "went", "saw", "is known that", "the work", "Élodie Ñu"]
    out = []
    for _ in range(n):
        parts = [" ".join(r.choices(words, k=r.randint(1, 6))) for _ in range(r.randint(1, 7))]
        out.append("".join(p[0].upper() + p[1:] + r.choice([". ", "! ", ".\n\n", "? "]) for p in parts))
    return out


def test_sieves_against_loops(spark, sf_dir):
    texts = random_texts(250) + [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    got = resolved(spark, texts)
    assert sum(len(e) for _, e in got) > 100
    for text, (_, edits) in zip(texts, got, strict=True):
        assert [(e.start, e.end, e.name) for e in edits] == plain(text or ""), text


def test_spans_lead_back(spark):
    text = "Mrs Curie came. Then she and her friend left. The end"
    df = spark.createDataFrame([(1, text)], "id long, text string")
    done = co.resolve(df, "rules")
    new = done.first().text
    spans = [("friend", "friend"), ("Mrs Curie and Mrs Curie's friend", "she and her friend"), ("Curie's friend", "her friend"), ("The end", "The end"), ("came", "came")]
    for said, meant in spans:
        a = new.rindex(said)
        start, end = co.original_span("edits", F.lit(a), F.lit(a + len(said)))
        x = done.select(start.alias("a"), end.alias("b")).first()
        assert text[x.a : x.b] == meant


def test_modes_and_columns(spark):
    df = spark.createDataFrame([(1, "Niels Bohr left. He ran.", "x", 5), (1, "Niels Bohr left. He ran.", "x", 5), (2, None, "y", None)], "id long, text string, edits string, pos long")
    assert co.resolve(df).collect() == df.collect() == co.resolve(df, "other").collect() == co.resolve(df, "model").collect()
    done = co.resolve(df, "rules").orderBy("id").collect()
    assert [(r.id, r.text, r.pos, len(r.edits)) for r in done] == [(1, "Niels Bohr left. Niels Bohr ran.", 5, 1)] * 2 + [(2, None, None, 0)]
    model = lambda t: F.when(t.contains("ran"), F.lit(" said \n")).otherwise(F.lit(" "))
    assert [r.text for r in co.resolve(df, "model", model=model).orderBy("id").collect()] == ["said", "said", None]
    assert co.resolve(df.limit(0), "rules").count() == 0


def test_one_shuffle_of_texts(spark):
    plan = co.resolve(spark.createDataFrame([(1, "a")], "id long, text string"), "rules")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange hashpartitioning(_text_key") <= 2


if __name__ == "__main__":
    pytest.main([__file__])
