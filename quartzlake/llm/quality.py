"""Line-first text cleaning, in DataFrame functions only.

Every line is judged by itself: navigation, boilerplate, shouting, symbols, repetition and a missing end of sentence.
Lines that fail are removed, and a document that loses more than MAX_LOST of its word characters is rejected, as is one
that fails the base rules (fewer than MIN_WORDS words, or over MAX_REPEAT percent of its words in repeated windows).

All of it is row-local: no shuffle. Repeated windows are found by sorting the hashes of a document's own five-word windows,
and positions are sorted only for documents that have a repeat.

Defined cases: null texts have no words and fail the base rules, as do empty ones; rows with one doc_id twice are
judged apart; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES

WINDOW, MIN_WORDS, MAX_REPEAT, MAX_LOST = 5, 10, 20, 0.5
#: Limits within a line: separators and symbols to words, distinct to all words.
MAX_SEPARATORS, MAX_SYMBOLS, MIN_DISTINCT = 0.2, 0.2, 0.4
#: Words that a line needs before shouting, repetition or a missing end of sentence count against it; words from which a line
#: is prose, so that a missing end or a boilerplate phrase does not count.
SHORT_LINE, LONG_LINE = 4, 20
SYMBOLS = "#*$%&|<>"
# Phrases of boilerplate lines, lower case.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "we use cookies", "click here", "read more",
    "sign up", "log in", "subscribe to our", "share this", "powered by", "lorem ipsum",
)
# Characters that a sentence may end with.
ENDS = (".", "!", "?", ":", ";", "…", "。", "！", "？", '"', "'", "”", "’", "»", ")", "]")


def _symbols(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))


def line_measures(line: Column) -> Column:
    """What the rules look at, each computed once for a line."""
    words = F.array_remove(F.split(line, f"[{SPACES}]+"), "")
    return F.struct(line.alias("line"), words.alias("words"), _symbols(line).alias("symbols"))


def failed_rule(x: Column) -> Column:
    """Name of the first rule that a measured line fails, or null."""
    line, n, enough = x["line"], F.size(x["words"]), F.size(x["words"]) >= SHORT_LINE
    separators = F.char_length(line) - F.char_length(F.replace(line, F.lit("|"), F.lit("")))
    lower, boiler = F.lower(line), F.lit(False)
    for phrase in BOILERPLATE:
        boiler = boiler | lower.contains(phrase)
    return (
        F.when((x["symbols"] > 0) & (separators > MAX_SEPARATORS * n), "navigation")
        .when((x["symbols"] > 0) & (x["symbols"] > MAX_SYMBOLS * n), "symbols")
        .when(enough & (F.size(F.array_distinct(x["words"])) < MIN_DISTINCT * n), "repetition")
        .when(enough & (F.upper(line) == line) & (F.lower(line) != line), "shouting")
        .when(enough & (n < LONG_LINE) & ~F.substring(F.rtrim(line), -1, 1).isin(*ENDS), "punctuation")
        .when((n < LONG_LINE) & boiler, "boilerplate")
    )


def _chars(measured: Column) -> Column:
    """Word characters of measured lines."""
    return F.char_length(F.array_join(F.flatten(F.transform(measured, lambda x: x["words"])), ""))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed, kept, clean_text (the lines that stay) and lost (share of word characters)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.transform(F.split("text", "\n"), line_measures).alias("measured"))
    rows = rows.select(
        "doc_id", "measured",
        F.flatten(F.transform("measured", lambda x: x["words"])).alias("words"),
        F.transform(F.filter("measured", lambda x: F.size(x["words"]) > 0), lambda x: x["line"]).alias("lines"),
        F.filter("measured", lambda x: failed_rule(x).isNull()).alias("good"),
    )
    starts = F.sequence(F.lit(0), F.size("words") - WINDOW)
    window = F.transform(starts, lambda i: F.xxhash64(*(F.get(F.col("words"), i + k) for k in range(WINDOW))))
    rows = rows.withColumn("windows", F.when(F.size("words") > WINDOW, window))
    sorted_ = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("ranked", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), sorted_))
    same = lambda x, j: F.coalesce(F.get("ranked", j)["h"] == x["h"], F.lit(False))
    twice = F.filter("ranked", lambda x, j: same(x, j - 1) | same(x, j + 1))
    rows = rows.withColumn("at", F.array_sort(F.transform(twice, lambda x: x["i"])))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("at", start, lambda s, i: F.struct((s["n"] + i + WINDOW - F.greatest(s["end"], i)).alias("n"), (i + WINDOW).alias("end")), lambda s: s["n"])
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.aggregate("measured", F.lit(0), lambda n, x: n + x["symbols"]).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array_join(F.transform("good", lambda x: x["line"]), "\n").alias("clean_text"),
        _chars(F.col("good")).alias("kept_chars"),
    )
    lost = F.when(F.col("word_chars") > 0, (F.col("word_chars") - F.col("kept_chars")) / F.col("word_chars")).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    rows = rows.withColumn("lost", lost).withColumn("base_failed", failed).drop("kept_chars")
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= MAX_LOST))
