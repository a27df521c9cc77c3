"""The boundary to language models: what goes in, what it costs, and what comes back in whatever shape.

Everything here is a column function, so a model's answers are read where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.terms import col, token_estimate

TRIPLE = "struct<subject:string,predicate:string,object_value:string,confidence:double>"
# Names under which models wrap their list, and letters that JSON escapes.
ENVELOPES = ("tasks", "triples", "items", "data", "results", "extractions")
ESCAPES = r'["\\/bfnrtu]'

# US dollars for a thousand tokens, in and out; other models count as free.
RATES = {
    "gpt-4o": (0.005, 0.015),
    "gpt-4o-mini": (0.00015, 0.0006),
    "gpt-4-turbo": (0.01, 0.03),
    "gpt-4-turbo-preview": (0.01, 0.03),
    "gpt-4": (0.03, 0.06),
    "gpt-3.5-turbo": (0.001, 0.002),
    "gpt-3.5-turbo-0125": (0.0005, 0.0015),
    "claude-3-5-sonnet-20241022": (0.003, 0.015),
    "claude-3-5-haiku-20241022": (0.001, 0.005),
    "claude-3-opus-20240229": (0.015, 0.075),
    "claude-3-sonnet-20240229": (0.003, 0.015),
    "claude-3-haiku-20240307": (0.00025, 0.00125),
    "gemini-1.5-pro": (0.00125, 0.005),
    "gemini-1.5-flash": (0.000075, 0.0003),
    "gemini-1.0-pro": (0.0005, 0.0015),
    "mistral-large-latest": (0.004, 0.012),
    "mistral-small-latest": (0.001, 0.003),
    "mistral-7b-instruct-v0.2": (0.00025, 0.00025),
}


def cost(model, tokens_in, tokens_out) -> Column:
    """US dollars of a call; a model without a rate is free."""
    rate = lambda i: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in RATES.items() for x in (k, v[i])]), F.lower(col(model))), F.lit(0.0))
    return col(tokens_in) / 1000 * rate(0) + col(tokens_out) / 1000 * rate(1)


def cost_text(usd) -> Column:
    usd = col(usd)
    return F.when(usd == 0, "$0.00 (free)").when(usd < 0.0001, F.format_string("$%.6f", usd)).otherwise(F.format_string("$%.4f", usd))


def prompt_hash(prompt) -> Column:
    return F.sha2(col(prompt), 256)


def entailment(entailed, contradicted) -> Column:
    """struct(supported, verifier_confidence): supported unless contradiction is likelier; the confidence is that of the side taken."""
    supported = col(entailed) >= col(contradicted)
    return F.struct(supported.alias("supported"), F.when(supported, col(entailed)).otherwise(col(contradicted)).alias("verifier_confidence"))


def repaired_json(content) -> Column:
    """A model's answer without fences, and without escapes that JSON does not know."""
    text = F.trim(F.coalesce(col(content), F.lit("")))
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    text = F.when(fenced != "", F.trim(fenced)).otherwise(text)
    return F.regexp_replace(text, rf"(\\{ESCAPES})|\\(.)", "$1$2")


def once(x: Column, f) -> Column:
    """f(x), with x worked out once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def answered_triples(content) -> Column:
    """array<TRIPLE> of an answer: its JSON list, that of an envelope, the same with Markdown links as their text, or what fields can be found.

    An answer with nothing in it gives an empty array, as does an object under another name that holds no such fields; a confidence that is no number is null.
    """
    kind = f"array<{TRIPLE}>".replace("double", "string")  # models write numbers as strings as well

    def read(x: Column) -> Column:
        whole = F.when(x.startswith("["), F.from_json(x, kind))
        inside = [F.when(x.startswith("{"), F.from_json(F.get_json_object(x, f"$.{k}"), kind)) for k in ENVELOPES]
        typed = lambda found: F.transform(found, lambda t: t.withField("confidence", t["confidence"].try_cast("double")))
        return once(F.coalesce(whole, *inside), lambda found: F.when(F.size(F.filter(found, lambda t: t["subject"].isNull())) == 0, typed(found)))

    # fixed value: four fields in their usual order, where the answer is no JSON
    field = r'"subject"\s*:\s*"([^"]+)"\s*,\s*"predicate"\s*:\s*"([^"]+)"\s*,\s*"object_value"\s*:\s*"([^"]+)"\s*,\s*"confidence"\s*:\s*([0-9.]+)'

    def loose(text: Column) -> Column:
        part = lambda i: F.regexp_extract_all(text, F.lit(field), F.lit(i))
        return F.transform(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), part(4).alias("d")), lambda z: F.struct(z["a"].alias("subject"), z["b"].alias("predicate"), z["c"].alias("object_value"), z["d"].cast("double").alias("confidence")))
    # fixed value: Markdown links
    plain = lambda text: F.regexp_replace(text, r'\[([^"\]\n]*)\]\((?:[^()]|\([^()]*\))*\)', "$1")
    return once(repaired_json(content), lambda text: F.coalesce(read(text), once(plain(text), read), loose(text)))


# Sections of a prompt that go first when it is too long.
LESS_NEEDED = ("EXAMPLES:", "CORPUS CONTEXT:", "ENTITY CATALOG:", "DOCUMENT SUMMARY:")


def prompt(*sections: tuple[str, Column]) -> Column:
    """Sections (title, body) one below the other, each after an empty line; those without a body are left out."""
    return F.concat_ws("\n\n", *[F.when(F.coalesce(F.trim(body), F.lit("")) != "", F.concat(F.lit(f"{title}\n" if title else ""), body)) for title, body in sections])


def within_budget(system, fragment, most_tokens: int) -> Column:
    """The system prompt, less one section after the other (a title's line to the next empty line) while it and the fragment exceed the budget; then cut."""
    room = F.lit(most_tokens) - token_estimate(fragment)
    out = col(system)
    for title in LESS_NEEDED:
        without = F.regexp_replace(out, rf"(?dm)^[^\n]*{title}[^\n]*(?:\n[^\n]+)*\n?(?:\n|\z)", "")
        out = F.when(token_estimate(out) > room, without).otherwise(out)
    # Characters of a token, and the least that is left of a prompt.
    return F.when(token_estimate(out) > room, F.substring(out, F.lit(1), F.greatest(F.lit(200), (4 * room).cast("int")))).otherwise(out)


def catalog_lines(rows: DataFrame, by: str = "source_iri", most: int = 50) -> DataFrame:
    """by, catalog: "- label (type): iri" of the entities of a text, most mentioned first."""
    w = Window.partitionBy(by).orderBy(F.desc("n"), "label", "iri")
    line = F.concat(F.lit("- "), "label", F.when(F.col("type").isNotNull(), F.concat(F.lit(" ("), "type", F.lit(")"))).otherwise(""), F.lit(": "), "iri")
    kept = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).select(by, "_n", line.alias("line"))
    return kept.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "line"))), lambda x: x["line"]), "\n").alias("catalog"))


CONTEXT_TITLE = "KNOWN GRAPH CONTEXT (use these exact IRIs for matching entities):"  # a fixed value


def known_graph_context(entities: DataFrame, most_words: int = 200, by: str = "fragment_key") -> DataFrame:
    """by, n_found, n_lines, words, block: a line for each known entity (iri, label, property, value, place), until the next one would exceed the words."""
    own = F.concat(F.lit("  <"), "iri", F.lit(">"), F.coalesce(F.concat(F.lit('  rdfs:label  "'), F.nullif("label", F.lit("")), F.lit('"')), F.lit("")))
    local = F.substring_index(F.substring_index("property", "/", -1), "#", -1)
    fact = F.concat(F.lit("  ;  "), local, F.lit('  "'), F.substring("value", 1, 60), F.lit('"'))
    line = F.concat(own, F.coalesce(F.when((F.col("property") != "") & (F.col("value") != ""), fact), F.lit("")))
    own_order = Window.partitionBy(by).orderBy("place")
    known = entities.where("iri <> ''")
    n_found = known.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("n_found"))
    # a line has a word at least, so later ones than this cannot fit
    first = known.withColumn("_n", F.row_number().over(own_order)).where(F.col("_n") <= max(1, most_words))
    rows = first.withColumn("line", line).withColumn("w", F.size(F.split(F.trim("line"), r"\s+")))
    rows = rows.withColumn("upto", len(CONTEXT_TITLE.split()) + F.sum("w").over(own_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    fits = F.col("upto") <= most_words
    lines = F.transform(F.array_sort(F.collect_list(F.when(fits, F.struct("place", "line")))), lambda x: x["line"])
    out = rows.groupBy(by).agg(F.count_if(fits).alias("n_lines"), F.max(F.when(fits, F.col("upto"))).alias("words"), lines.alias("l"))
    return out.where("n_lines > 0").join(n_found, F.col(by).eqNullSafe(F.col("_by"))).select(by, "n_found", "n_lines", "words", F.concat(F.lit(CONTEXT_TITLE + "\n"), F.array_join("l", "\n")).alias("block"))


def nested(overrides: dict[str, str]) -> dict:
    """{"a.b": x} as {"a": {"b": x}}; later keys win."""
    out: dict = {}
    for dotted, value in overrides.items():
        *path, last = dotted.split(".")
        at = out
        for part in path:
            at = at.setdefault(part, {})
        at[last] = value
    return out
