"""Quality rules, line first, in DataFrame functions only.

Each distinct line (a repeated line fails from its second place on) is tested
for punctuation, navigation and boilerplate; lines that fail are removed, and a
document that keeps less than ``min_kept`` percent of its word characters is
rejected, as is one that fails the base rules.

Everything about a document is computed inside its row: nothing is exploded or
shuffled.  Repeated 8-word windows are found by sorting the row's window hashes
only where a cheap distinct count shows that there are any.  ``let`` binds a
value once; Catalyst would otherwise paste its expression into each lambda.

A null or empty text has no words and so fails the base rules.  Repeated rows and
null ids are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from .text import carried_columns

WHITE = r"[\x20\x09-\x0D]+"
WHITE_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Rules of a line.
END_MARKS = ".!?:;,…\"'”’»)]"
SEPARATORS = "|»›•·>"
NAVIGATION = 3  # separators in a line
BOILERPLATE = ("cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "sign in", "log in", "subscribe now", "click here", "enable javascript", "read more", "share this", "skip to content", "skip to main content", "back to top", "lorem ipsum")
SHORT_LINE = 3  # words; a shorter line needs no end mark
MAX_SYMBOLS = 20  # percent of a line's word characters
MIN_KEPT = 50  # percent of a document's word characters


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Of a text that has one; otherwise one empty word."""
    return F.split(F.trim(text, F.lit(WHITE_CHARS)), WHITE)


def count_words(text: Column) -> Column:
    return F.when(F.trim(text, F.lit(WHITE_CHARS)) == "", 0).otherwise(F.size(words(text))).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, WHITE_CHARS, "")).cast("long")


def symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(WHITE_CHARS)) != "")


def _repeated(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice."""

    def places(s: Column) -> Column:
        same = lambda e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, same), lambda e: e["i"]))

    def union_size(p: Column) -> Column:
        gaps = F.zip_with(F.slice(p, F.lit(2), F.size(p)), F.slice(p, F.lit(1), F.size(p) - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(WINDOW).cast("long"), lambda n, g: n + g)

    def found(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(let(pairs, places), union_size))

    return let(windows, found)


def _joined(h: Column, step: int) -> Column:
    """Hashes of h[i] and h[i + step] together."""
    n = F.size(h) - step
    return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b))


def counted_words(text: Column) -> Column:
    """struct(n_words, n_repeat_words); windows of eight are hashed as pairs of pairs of pairs of word hashes."""

    def of(h: Column) -> Column:
        n = F.size(h)
        windows = let(_joined(h, 1), lambda two: let(_joined(two, 2), lambda four: _joined(four, 4)))
        repeated = F.when(n > WINDOW, _repeated(windows)).otherwise(F.lit(0).cast("long"))
        return F.struct(n.cast("long").alias("n_words"), repeated.alias("n_repeat_words"))

    none = F.struct(F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_repeat_words"))
    return F.when(word_chars(text) == 0, none).otherwise(let(F.transform(words(text), lambda w: F.xxhash64(w)), of))


def boilerplate(text: Column) -> Column:
    low = F.lower(text)
    return reduce(or_, [F.contains(low, F.lit(x)) for x in BOILERPLATE])


def separators(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SEPARATORS, ""))


def bad_line(line: Column, flags: Column) -> Column:
    """flags: n_symbols, n_separators and boilerplate of the whole text; lines are only searched for what it has."""
    unmarked = (F.instr(F.lit(END_MARKS), F.right(F.rtrim(line, F.lit(WHITE_CHARS)), F.lit(1))) == 0) & (count_words(line) > SHORT_LINE)
    symbolic = (flags["n_symbols"] > 0) & (symbols(line) * 100 > word_chars(line) * MAX_SYMBOLS)
    navigation = (flags["n_separators"] >= NAVIGATION) & (separators(line) >= NAVIGATION)
    return unmarked | symbolic | navigation | (flags["boilerplate"] & boilerplate(line))


def flags_of(text: Column) -> Column:
    return F.struct(symbols(text).alias("n_symbols"), separators(text).alias("n_separators"), boilerplate(text).alias("boilerplate"), word_chars(text).alias("word_chars"))


def kept_lines(text: Column) -> Column:
    return let(flags_of(text), lambda flags: F.filter(F.array_distinct(lines_with_words(text)), lambda line: ~bad_line(line, flags)))


def line_measures(text: Column) -> Column:
    """struct(n_dup_lines, kept_chars, word_chars, n_symbols); what is kept is what repeated and bad lines leave."""
    chars = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda n, line: n + word_chars(line))

    def of(lines: Column, distinct: Column, flags: Column) -> Column:
        n_dup = F.size(lines) - F.size(distinct)
        repeated = F.when(n_dup == 0, F.lit(0).cast("long")).otherwise(chars(lines) - chars(distinct))
        kept = flags["word_chars"] - repeated - chars(F.filter(distinct, lambda line: bad_line(line, flags)))
        return F.struct(n_dup.cast("long").alias("n_dup_lines"), kept.alias("kept_chars"), flags["word_chars"].alias("word_chars"), flags["n_symbols"].alias("n_symbols"))

    return let(flags_of(text), lambda flags: let(lines_with_words(text), lambda lines: let(F.array_distinct(lines), lambda distinct: of(lines, distinct, flags))))


def measures(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", min_kept: int = MIN_KEPT) -> DataFrame:
    """The columns ``keep``, the base measures, kept_chars, base_failed and kept; these replace columns of their names."""
    keep = carried_columns(keep, ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept_chars", "base_failed", "kept"))
    t = F.coalesce(F.col(text), F.lit(""))
    df = documents.select(*keep, counted_words(t).alias("_w"), line_measures(t).alias("_l"))
    df = df.select(*keep, "_w.n_words", "_l.word_chars", "_l.n_symbols", "_l.n_dup_lines", "_w.n_repeat_words", "_l.kept_chars")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & (100 * F.col("kept_chars") >= min_kept * F.col("word_chars")))


def clean(documents: DataFrame, text: str = "text", min_kept: int = MIN_KEPT) -> DataFrame:
    """Documents that pass, with the failing and repeated lines removed from their text."""
    rows = documents.select(F.struct(*documents.columns).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    passed = measures(rows, ("_row", "_text"), "_text", min_kept).where("kept")
    return passed.select(*[F.array_join(kept_lines(F.col("_text")), "\n").alias(text) if c == text else F.col(f"_row.{c}") for c in documents.columns])
