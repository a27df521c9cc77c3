"""Column functions on names, literals, labels, dates, vectors and hashes.

All are compositions of built-in functions and stay inside code generation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ..schema import PREFIXES, PROTECTED, UNKNOWN_PREFIX


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# names

def spaces_to_underscore(x):
    return F.regexp_replace(col(x), r"\s+", "_")


def expand(x):
    """Compact name -> full IRI; full ones and bare text stay."""
    x = col(x)
    prefix, local = F.substring_index(x, ":", 1), F.regexp_extract(x, r"^[^:]*:(.*)$", 1)
    known = F.create_map(*[F.lit(v) for kv in PREFIXES.items() for v in kv])
    full = F.concat(F.coalesce(F.try_element_at(known, prefix), F.concat(F.lit(UNKNOWN_PREFIX), prefix, F.lit("/"))), spaces_to_underscore(local))
    return F.when(is_iri(x) | ~x.rlike(r"^[A-Za-z][A-Za-z0-9_-]*:"), x).otherwise(full)


def is_iri(x):
    return col(x).rlike("^https?://")


def is_entity(x):
    return col(x).rlike("^(https?://|ex:)")


def escape_literal(x):
    x = col(x)
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def encode_term(x):
    """N-Triples form of an IRI, a compact name, a typed literal or plain text."""
    x = col(x)
    typed = F.regexp_extract(x, r'^"(.*)"\^\^(.+)$', 1)
    kind = F.regexp_extract(x, r'^"(.*)"\^\^(.+)$', 2)
    compact = x.rlike(r"^[A-Za-z][A-Za-z0-9_-]*:[^\s]+$")
    quoted = lambda v: F.concat(F.lit('"'), escape_literal(v), F.lit('"'))
    return (
        F.when(x.rlike("^<.*>$"), x)
        .when(is_iri(x), F.concat(F.lit("<"), x, F.lit(">")))
        .when(kind != "", F.concat(quoted(typed), F.lit("^^<"), expand(kind), F.lit(">")))
        .when(x.startswith("literal:"), quoted(F.substring(x, F.lit(9), F.length(x))))
        .when(compact, F.concat(F.lit("<"), expand(x), F.lit(">")))
        .otherwise(quoted(x))
    )


def local_name(x):
    """After the last #, else the last /, else the last colon."""
    x = F.regexp_replace(col(x), "/$", "")
    return F.when(F.instr(x, "#") > 0, F.substring_index(x, "#", -1)).when(F.instr(x, "/") > 0, F.substring_index(x, "/", -1)).otherwise(F.substring_index(x, ":", -1))


def namespace(x):
    x = col(x)
    return F.substring(x, F.lit(1), F.length(x) - F.length(local_name(x)))


def label_of(x):
    """partOf -> "part of": camel case, _ and - become spaces."""
    name = F.regexp_replace(local_name(x), "([a-z0-9])([A-Z])", "$1 $2")
    return F.lower(F.trim(F.regexp_replace(F.translate(name, "_-", "  "), " +", " ")))


def camel_case(x):
    words = F.filter(F.split(col(x), r"[\s_\-/]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), "")


def decode_escape(x):
    """One bare uXXXX escape."""
    x = col(x)
    code = F.regexp_extract(x, "u([0-9a-fA-F]{4})", 1)
    return F.when(code != "", F.replace(x, F.concat(F.lit("u"), code), F.decode(F.unhex(code), "UTF-16BE"))).otherwise(x)


def bare(x):
    """For comparison with a ground truth: lower case, without brackets, datatype, namespace and quotes."""
    x = F.regexp_replace(F.lower(F.trim(col(x))), "^<|>$", "")
    x = F.regexp_replace(x, r"\^\^.*$", "")
    x = F.substring_index(F.substring_index(x, "/", -1), "#", -1)
    return F.trim(F.regexp_replace(F.regexp_replace(x, "^[a-z]+:", ""), '"', ""))


def alnum(x):
    return F.regexp_replace(F.lower(col(x)), "[^a-z0-9]", "")


def slug(x, most: int = 120):
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")), 1, most)


def with_prefix(x, prefix: str = "ex:"):
    return F.when(F.instr(col(x), ":") == 0, F.concat(F.lit(prefix), spaces_to_underscore(x))).otherwise(col(x))


def entity_or_literal(x):
    """Text that looks like a proper noun becomes an ex: name; other text stays."""
    x = F.trim(F.regexp_replace(F.trim(col(x)), r"\s*\([^)]*\)$", ""))
    small = F.array(*[F.lit(w) for w in ("of", "the", "and", "in", "for", "on", "at", "de", "la", "von")])
    proper = F.forall(F.split(x, r"\s+"), lambda w: w.rlike("^[A-Z]") | F.array_contains(small, w))
    literal = (F.length(x) > 120) | x.rlike("^[0-9]") | (F.instr(x, ":") > 0) | ~x.rlike("^[A-Z]")
    return F.when(F.lower(x).isin("true", "false"), F.concat(F.lit('"'), F.lower(x), F.lit('"^^xsd:boolean'))).when(literal | ~proper, x).otherwise(F.concat(F.lit("ex:"), spaces_to_underscore(x)))


def protected(x):
    return reduce(lambda a, b: a | b, [col(x).startswith(PREFIXES[p]) | col(x).startswith(p + ":") for p in PROTECTED])


# text

# Words of a question that name nothing.
QUESTION_WORDS = (
    "what", "which", "who", "how", "where", "when", "is", "are", "does", "do", "the", "a", "an", "of", "in", "to", "for", "with", "has", "have",
)


def keywords(x):
    """Words of three characters or more that are none of QUESTION_WORDS; question marks and commas go, other marks stay with their word."""
    words = F.split(F.regexp_replace(F.lower(col(x)), "[?,]", ""), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*QUESTION_WORDS))


def candidate_tokens(x, most: int = 30):
    """Distinct identifiers, longest first, then by text."""
    found = F.array_distinct(F.regexp_extract_all(col(x), F.lit(r"[A-Za-z][A-Za-z0-9_\-]*"), 0))
    return F.slice(F.transform(F.array_sort(F.transform(found, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda s: s["w"]), 1, most)


def sentence(s, p, o):
    return F.concat(F.concat_ws(" ", label_of(s), label_of(p), F.when(is_entity(o), label_of(o)).otherwise(col(o))), F.lit("."))


def word_count(x):
    return F.size(F.regexp_extract_all(col(x), F.lit(r"\w+"), 0))


def token_estimate(x):
    return F.greatest(F.lit(1), F.floor(F.octet_length(col(x)) / 4)).cast("long")


def sentences(x):
    return F.filter(F.split(F.trim(col(x)), r"(?<=[.!?])\s+"), lambda s: s != "")


def html_text(x):
    x = F.regexp_replace(col(x), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"\s+", " "))


def wikilinks(x):
    return F.regexp_extract_all(col(x), F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), 1)


def trigrams(x):
    """Of the lower-cased text with two spaces before and one after it."""
    padded = F.concat(F.lit("  "), F.lower(col(x)), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def jaccard(a, b):
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


# dates: their written forms, the years that count and the units of a span are fixed values

def iso_date(x):
    forms = ("yyyy-MM-dd", "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "MMMM d, yyyy")
    return F.coalesce(*[F.date_format(F.try_to_date(col(x), f) if hasattr(F, "try_to_date") else F.expr("null"), "yyyy-MM-dd") for f in forms])


def year(x):
    return F.regexp_extract(col(x), r"\b(1\d{3}|20\d{2})\b", 1)


def seconds_of(x):
    """30d, 48h, 15m, 20s; days where no unit is given."""
    x = F.lower(F.trim(col(x)))
    n = F.try_to_number(F.regexp_extract(x, "^([0-9]+)", 1), F.lit("999999999")).cast("long")
    unit = F.regexp_extract(x, "([a-z]?)$", 1)
    return n * F.when(unit == "h", 3600).when(unit == "m", 60).when(unit == "s", 1).otherwise(86400)


def timestamp_of(x):
    forms = ("yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(col(x), F.lit(f)) for f in forms])


# numbers and vectors

def dot(a, b):
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b):
    """0 where a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def unit(v):
    norm = F.sqrt(dot(v, v))
    return F.transform(col(v), lambda x: x / F.when(norm > 0, norm).otherwise(F.lit(1.0)))


def softmax(v):
    e = F.transform(col(v), lambda x: F.exp(x - F.array_max(col(v))))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def clamp(x, low: float = 0.0, high: float = 1.0):
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def hash_share(*parts):
    """A number from 0 to 1 that only depends on the text."""
    return F.conv(F.substring(F.md5(F.concat(*[col(p) for p in parts])), 1, 8), 16, 10).cast("long") / F.lit(4294967295.0)


def content_hash(x):
    return F.md5(col(x))


def short_hash(x, n: int = 16):
    return F.substring(F.sha2(col(x), 256), 1, n)


# labels and texts for evaluation

def evaluation_label(x):
    """The name of an IRI or compact name as words: after the colon of a short one, else after the last / or #; camel case is split."""
    x = col(x)
    name = F.when(x.contains(":") & ~x.contains("/"), F.regexp_replace(x, "^[^:]*:", "")).otherwise(F.regexp_extract(x, "([^/#]*)$", 1))
    return F.trim(F.regexp_replace(F.translate(name, "_-", "  "), "([a-z])([A-Z])", "$1 $2"))


def plain_sentences(x):
    """Every run that ends at . ! or ?, and the rest; trimmed, blank ones left out."""
    runs = F.regexp_extract_all(col(x), F.lit(r"(?s)[^.!?]*[.!?]|[^.!?]+$"), F.lit(0))
    return F.filter(F.transform(runs, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def article_title(x):
    """The title in an article's address, decoded and without its fragment; other text stays."""
    x = F.trim(col(x))
    path = F.replace(F.substring_index(x, "/wiki/", -1), F.lit("_"), F.lit(" "))
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.when(x.contains("/wiki/"), F.substring_index(F.coalesce(decoded, path), "#", 1)).otherwise(x)


def merged_map(defaults, overrides):
    """Both maps' entries; overrides win."""
    return F.map_concat(F.map_filter(col(defaults), lambda k, _: ~F.array_contains(F.map_keys(col(overrides)), k)), col(overrides))


def cursor_offsets(text, parts):
    """Where each part begins in the text, searched from the end of the part before; one that is not there begins at that end."""
    text = col(text)

    def step(a, part):
        found = F.position(part, text, (a["at"] + 1).cast("int")) - 1
        start = F.when(found >= 0, found).otherwise(a["at"]).cast("int")
        return F.struct((start + F.length(part)).cast("int").alias("at"), F.concat(a["starts"], F.array(start)).alias("starts"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(col(parts), first, step, lambda a: a["starts"])


def iso(at=None) -> Column:
    """A time as ISO text in UTC, with microseconds where it has any; without one, that of the query (each row the same)."""
    utc = F.to_utc_timestamp(F.current_timestamp() if at is None else col(at), F.current_timezone())
    parts = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(parts, r"\.000000$", ""), F.lit("+00:00"))
