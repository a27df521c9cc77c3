"""Coreference: pronouns become the names that they stand for, where one name alone fits.

Names, pronouns and sentence ends are found in the row; the sieves are windows over the
mentions of a text, so a text is shuffled once, equal texts are resolved once, and no
Python runs.  The sieves, in order: a short name is the one longer name that begins or
ends with it; a pronoun is the only name that agrees with it in the nearest of the
sentences up to ``reach`` back that has one; in the next pass, genders and kinds that this
showed count, and pronouns so resolved are mentions too.  Two names that agree leave a
pronoun as it is.  An "it" within a sentence stays, as common nouns are not followed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.terms import col
from ..plans.lineage import parts

# English closed-class words and what tells the kind of a name.
FEMALE = ("Mrs", "Ms", "Miss", "Lady", "Dame", "Queen", "Princess")
MALE = ("Mr", "Sir", "Lord", "King", "Prince")
EITHER = ("Dr", "Prof", "Professor", "President", "Judge")
THINGS = (
    "University", "Institute", "Academy", "Society", "Company", "Corporation", "Inc", "Ltd", "Corp", "Bank", "Museum",
    "Committee", "Council", "Party", "Union", "River", "Lake", "Ocean", "Sea", "Mountain", "City", "Street", "College",
)
NO_NAMES = (
    "The", "A", "An", "This", "That", "These", "Those", "There", "Then", "Here", "In", "On", "At", "By", "For", "From",
    "To", "Of", "With", "After", "Before", "When", "While", "Where", "Who", "What", "Why", "How", "If", "As", "And",
    "But", "Or", "Nor", "So", "Yet", "However", "Also", "Although", "Because", "Since", "During", "Its", "His", "Her",
    "Their", "He", "She", "It", "They", "We", "I", "You", "My", "Our", "Your", "Not", "No", "Yes", "All", "Some",
    "Both", "Each", "Many", "Most", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December",
)
#: Each pronoun's class: m, f, n (a thing) or p (two names), and its case.
PRONOUNS = {
    "he": ("m", "subject"), "him": ("m", "object"), "his": ("m", "owner"),
    "she": ("f", "subject"), "her": ("f", "object"), "hers": ("f", "owner"),
    "it": ("n", "subject"), "its": ("n", "owner"),
    "they": ("p", "subject"), "them": ("p", "object"), "their": ("p", "owner"), "theirs": ("p", "owner"),
}
CLASSES = ("m", "f", "n", "p")
#: What follows a "her" that is an object, an "it" that stands for nothing, and stands before the name of a place.
OBJECT_NEXT = r"^(?: (?:that|to|in|on|at|by|for|from|with|and|or|but|as|when|while|who|the|a|an|was|is|had|has)\b|[^ ]|$)"
EMPTY_IT = r"^ (?:(?:is|was|seems|seemed|appears|appeared|turns out|turned out)\b[^.]*? (?:that|to)\b|rain|snow)"
PLACE_BEFORE = r"(?:^|\s)(?:in|at|near|from|into|to) $"

_WORD = rf"(?!(?:{'|'.join(NO_NAMES)})(?![\p{{L}}\p{{N}}]))(?:\p{{Lu}}\.(?= \p{{Lu}})|\p{{Lu}}[\p{{L}}\p{{M}}\p{{N}}-]*+(?:['’]\p{{Lu}}[\p{{L}}\p{{M}}-]*+)?)"
_TITLE = rf"(?:{'|'.join((*FEMALE, *MALE, *EITHER))})\.? "
_NAME = rf"(?:{_TITLE})?{_WORD}(?: (?:of |de |van |von )?{_WORD}){{0,5}}"
_PRONOUN = rf"(?:{'|'.join(f'[{p[0].upper()}{p[0]}]{p[1:]}' for p in sorted(PRONOUNS, key=len, reverse=True))})(?![\p{{L}}\p{{N}}_])"
_PIECE = rf"(?s)(.*?)((?<![\p{{L}}\p{{M}}\p{{N}}_])(?:{_PRONOUN}|{_NAME})|[.!?]+(?=\s|\z)|\n[^\S\n]*\n|\z)"

PART = 1_000_000  # characters of a partition's texts
EDIT = "struct<start:int,end:int,new_start:int,new_end:int,pronoun:string,name:string>"


def mentions(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, pos, before, m, kind, sentence, start: all of a text in pieces that end with a mention, a sentence end or the text's.

    kind is name, pronoun, end or tail.  Joined in the order of pos, ``before`` and ``m`` are the text.
    """
    gaps, found = (F.regexp_extract_all(text, F.lit(_PIECE), g) for g in (1, 2))
    rows = texts.select(key, F.posexplode_outer(F.arrays_zip(gaps.alias("before"), found.alias("m"))).alias("pos", "x"))
    rows = rows.select(key, "pos", F.col("x.before").alias("before"), F.col("x.m").alias("m"))
    m = F.col("m")
    kind = F.when(m == "", "tail").when(m.rlike(r"^[.!?\n]"), "end").when(F.lower("m").isin(*PRONOUNS), "pronoun").otherwise("name")
    w = Window.partitionBy(key).orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("kind", kind)
    passed = F.coalesce(F.sum(F.length("before") + F.length("m")).over(before), F.lit(0))
    ends = F.coalesce(F.sum((F.col("kind") == "end").cast("int")).over(before), F.lit(0))
    return rows.withColumns({"sentence": ends, "start": (passed + F.length("before")).cast("int")})


def opens(key: str) -> Column:
    """Whether a mention is the first word of its sentence."""
    last = F.lag("kind").over(Window.partitionBy(key).orderBy("pos"))
    return F.col("before").rlike(r"^\s*$") & (F.coalesce(last, F.lit("end")) == "end")


def named(rows: DataFrame, key: str) -> DataFrame:
    """With entity (the longest name that a name is part of, if there is one alone), shown, and what its form tells: f, m, person, n.

    A single word without a title that only ever opens sentences may be no name: it is not shown, and no mention.
    """
    name = F.when(F.col("kind") == "name", F.col("m"))
    bare = F.regexp_replace(name, rf"^{_TITLE}", "")
    parts = F.split(bare, " ")
    d = rows.withColumns({"_bare": bare, "_first": parts[0], "_last": F.element_at(parts, -1), "_long": F.when(F.size(parts) > 1, bare)})

    def only(by: str) -> Column:
        w = Window.partitionBy(key, by)
        return F.when(F.min("_long").over(w) == F.max("_long").over(w), F.min("_long").over(w))

    d = d.withColumns({"_by_last": only("_last"), "_by_first": only("_first")})
    d = d.withColumn("entity", F.coalesce("_long", "_by_last", "_by_first", "_bare"))
    title = F.regexp_extract("m", rf"^({'|'.join((*FEMALE, *MALE, *EITHER))})\.? ", 1)
    w = Window.partitionBy(key, "entity")
    some = lambda test: F.max(F.when(F.col("kind") == "name", test)).over(w)
    thing = F.arrays_overlap(F.split("_bare", " "), F.lit(list(THINGS))) | F.col("_bare").rlike(r"^[\p{Lu} ]{2,}$") | F.col("before").rlike(PLACE_BEFORE)
    d = d.withColumns({"f": some(title.isin(*FEMALE)), "m_": some(title.isin(*MALE)), "person": some(title != ""), "n": some(thing)})
    shown = F.when(F.col("entity").contains(" "), F.col("entity")).otherwise(F.max("m").over(w))
    sure = F.max((title != "") | F.col("_bare").contains(" ") | ~opens(key)).over(w)
    order = Window.partitionBy(key).orderBy("pos")
    two = (F.lag("kind").over(order) == "name") & (F.col("before") == " and ") & (F.col("kind") == "name")
    d = d.withColumn("_sure", sure).withColumn("shown", F.when((F.col("kind") == "name") & F.col("_sure"), shown))
    d = d.withColumn("pair", F.when(two, F.concat(F.lag("shown").over(order), F.lit(" and "), "shown")))
    return d.drop("_bare", "_first", "_last", "_long", "_by_last", "_by_first", "_sure")


def referred(rows: DataFrame, key: str, reach: int) -> DataFrame:
    """One pass: with ``referent``, the only name that agrees with a pronoun, by what is known of the names so far."""
    f, m, n, person = (F.coalesce(c, F.lit(False)) for c in ("f", "m_", "n", "person"))
    agrees = {"m": ~f & (~n | person | m), "f": ~m & (~n | person | f), "n": ~f & ~m & ~person}
    # What a pronoun was found to mean is a mention too.
    name = F.coalesce("shown", F.when(F.col("class") != "p", F.col("referent")))
    both = F.coalesce("pair", F.when(F.col("class") == "p", F.col("referent")))
    fits = {c: F.when(test, name) for c, test in agrees.items()} | {"p": both}
    own = Window.partitionBy(key, "sentence")
    past = own.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(key).orderBy("sentence").rangeBetween(-reach, -1)
    d = rows.withColumns({f"_fit_{c}": x for c, x in fits.items()})
    ends = {}
    for c in CLASSES:
        ends |= {f"_lo_{c}": F.min(f"_fit_{c}").over(past), f"_hi_{c}": F.max(f"_fit_{c}").over(past)}
        ends[f"_all_{c}"] = F.when(F.min(f"_fit_{c}").over(own).isNotNull(), F.struct(F.min(f"_fit_{c}").over(own).alias("lo"), F.max(f"_fit_{c}").over(own).alias("hi")))
    d = d.withColumns(ends)
    d = d.withColumns({f"_back_{c}": F.last(f"_all_{c}", True).over(back) for c in CLASSES})
    pick = lambda x: reduce(lambda a, c: F.when(F.col("class") == c, F.col(f"_{x}_{c}")).otherwise(a), CLASSES, F.lit(None))
    d = d.withColumns({"_lo": pick("lo"), "_hi": pick("hi"), "_back": pick("back")})
    earlier = F.when(F.col("_back.lo") == F.col("_back.hi"), F.col("_back.lo"))
    here = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
    none = F.col("_lo").isNull()
    subject = F.when(none, earlier).otherwise(here)
    # An object is not the one name before it in its sentence, as that would be "himself".
    aside = F.when(none, earlier).when(here.isNotNull() & (earlier != here), earlier)
    found = F.when(F.col("case") == "object", aside).when(F.col("case") == "opens", F.when(none, earlier)).when(F.col("case").isNotNull(), subject)
    d = d.withColumn("referent", found)
    return d.drop(*[x for x in d.columns if x.startswith(("_fit_", "_lo", "_hi", "_all_", "_back"))])


def edits(rows: DataFrame, key: str, reach: int = 2, passes: int = 2) -> DataFrame:
    """The mentions with ``referent`` and ``new``, which takes a pronoun's place (null: it stays)."""
    order = Window.partitionBy(key).orderBy("pos")
    after = F.coalesce(F.lead("before").over(order), F.lit(""))
    low = F.when(F.col("kind") == "pronoun", F.lower("m"))
    table = lambda i: F.create_map(*[F.lit(x) for p, v in PRONOUNS.items() for x in (p, v[i])])
    case = F.try_element_at(table(1), low)
    case = F.when((low == "her") & ~after.rlike(OBJECT_NEXT), "owner").when(low == "it", F.when(opens(key) & ~after.rlike(EMPTY_IT), "opens")).otherwise(case)
    d = named(rows, key).withColumns({"class": F.try_element_at(table(0), low), "case": case, "referent": F.lit(None).cast("string")})
    for _ in range(passes):
        d = referred(d, key, reach)
        who = Window.partitionBy(key, "_who")
        shows = lambda c: F.max(F.col("referent").isNotNull() & (F.col("class") == c)).over(who)
        d = d.withColumn("_who", F.coalesce("shown", "referent"))
        known = {"f": shows("f"), "m_": shows("m"), "n": shows("n"), "person": F.lit(False)}
        d = d.withColumns({k: F.coalesce(F.max(k).over(who), F.lit(False)) | F.coalesce(x, F.lit(False)) for k, x in known.items()}).drop("_who")
    return d.withColumn("new", F.when(F.col("case") == "owner", F.concat("referent", F.lit("'s"))).otherwise(F.col("referent")))


def by_rules(docs: DataFrame, text: str = "text", reach: int = 2, passes: int = 2) -> DataFrame:
    """The rows with their text resolved and ``edits``, by place; a null or empty text stays and has none.  Columns named edits are replaced."""
    key = "_text_key"
    keyed = docs.drop("edits").withColumn(key, F.sha2(text, 256))
    once = keyed.where(F.col(text).isNotNull()).select(key, F.col(text).alias("text")).dropDuplicates([key])
    size = once.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > PART:  # windows keep a partition's mentions in memory, several times
        n = parts(once, size, PART)
        # by the session's own number the shuffle before would do, and Spark joins that one's partitions
        once = once.repartition(n + (n == parts(once, 0, PART)), key)
    m = edits(mentions(once, key), key, reach, passes)
    put = F.coalesce("new", "m")
    w = Window.partitionBy(key).orderBy("pos")
    at = F.sum(F.length("before") + F.length(put)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    m = m.withColumn("_at", at)
    edit = F.struct(F.col("start"), (F.col("start") + F.length("m")).alias("end"), (F.col("_at") - F.length(put)).alias("new_start"), F.col("_at").alias("new_end"), F.col("m").alias("pronoun"), F.col("referent").alias("name"))
    piece = F.struct("pos", F.concat("before", put).alias("piece"))
    whole = m.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["piece"]), "").alias("_resolved"),
        F.array_sort(F.collect_list(F.when(F.col("new").isNotNull(), edit))).alias("edits"),
    )
    both = keyed.drop(text).join(whole, key, "left")
    out = [F.col("_resolved").alias(text) if c == text else F.col(c) for c in docs.columns if c != "edits"]
    return both.select(*out, F.coalesce("edits", F.lit([]).cast(f"array<{EDIT}>")).alias("edits"))


def resolve(docs: DataFrame, mode: str = "disabled", text: str = "text", model=None, **settings) -> DataFrame:
    """Texts before they are cut into fragments: ``rules`` (adds ``edits``), ``model`` (a column function), or as they are.

    A model that gives nothing leaves the text; so do ``model`` without one, and modes that are not known.
    """
    if mode == "rules":
        return by_rules(docs, text, **settings)
    if mode == "model" and model is not None:
        answer = F.regexp_replace(model(F.col(text)), r"(?U)^\s+|\s+$", "")
        return docs.withColumn(text, F.coalesce(F.nullif(answer, F.lit("")), F.col(text)))
    return docs


def original_span(edits, start, end) -> tuple[Column, Column]:
    """Where a span of a resolved text stands in the text before it; a span that cuts into a name takes the whole pronoun."""
    edits = col(edits)

    def back(at: Column, inside: str) -> Column:
        cut = F.filter(edits, lambda e: (e["new_start"] < at) & (at < e["new_end"]))
        done = F.filter(edits, lambda e: e["new_end"] <= at)
        return F.coalesce(F.try_element_at(cut, F.lit(1))[inside], at - F.try_element_at(done, F.lit(-1))["new_end"] + F.try_element_at(done, F.lit(-1))["end"], at)

    return back(col(start), "start"), back(col(end), "end")
