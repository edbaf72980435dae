"""Quality rules as one projection of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plume.llm.common import SPACES, words_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Frequent words of the four languages, fixed values.
STOP_WORDS = (
    "the of and to in a is that it for as with on be was by this are from at "
    "der die das und in zu den mit von sich des auf ist im dem nicht ein eine als auch "
    "de la le les et des en un une du que qui dans pour par sur au est pas avec "
    "de la que el en y a los se del las un por con una su para es al lo"
).split()

#: name, metric, least, most: a document is kept if every metric is within its bounds.
RULES = (
    ("length", "n_words", 50, None),
    ("mean word length", "mean_word", 2.0, 14.0),
    ("symbols per word", "symbol_ratio", None, 0.20),
    # shouted texts and table dumps, whose other ratios look normal
    ("words that end in ! or are bars", "mark_ratio", None, 0.25),
    ("stop words", "stop_ratio", 0.02, None),
    ("duplicate lines", "dup_line_ratio", None, 0.50),
)


def repeated_words(words: Column) -> Column:
    """Words within 3-word windows that are found twice or more in the array.

    Windows are compared by their 64-bit hashes. They are sorted with their
    places; those equal to a neighbour give the places where a repeated
    window starts, and each start covers three words, or as many as there
    are before the next start.
    """
    window = F.transform(words, lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    return F.slice(window, 1, F.greatest(F.size(words) - 2, F.lit(0)))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the metrics that the rules use, by built-in functions alone."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.regexp_replace(line, SPACES, "")) > 0)
    df = docs.select("doc_id", text.alias("text")).withColumn("words", words_of(F.col("text")))
    words = F.col("words")
    df = df.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        repeated_words(words).alias("windows"),
        F.size(F.filter(words, lambda w: w.endswith("!") | (w == "|"))).cast("long").alias("n_marks"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stops"),
    )
    hashes = F.col("windows.h")
    df = df.withColumn("windows", F.when(F.size(F.array_distinct(hashes)) < F.size("windows"), F.sort_array("windows")))
    sorted_windows = F.col("windows")
    starts = F.filter(
        sorted_windows,
        lambda x, k: (x["h"] == F.get(sorted_windows, k - 1)["h"]) | (x["h"] == F.get(sorted_windows, k + 1)["h"]),
    )
    df = df.withColumn("starts", F.sort_array(F.transform(starts, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("starts", lambda p, k: F.least(F.lit(3), F.coalesce(F.get(F.col("starts"), k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x
    )
    return df.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_marks",
        "n_stops",
    )


def verdict(rules=RULES) -> Column:
    """The threshold table as one boolean expression over the metrics."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    metrics = {
        "n_words": F.col("n_words"),
        "mean_word": F.col("word_chars") / n,
        "symbol_ratio": F.col("n_symbols") / n,
        "mark_ratio": F.col("n_marks") / n,
        "stop_ratio": F.col("n_stops") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    }
    kept = F.lit(True)
    for _, metric, least, most in rules:
        if least is not None:
            kept = kept & (metrics[metric] >= least)
        if most is not None:
            kept = kept & (metrics[metric] <= most)
    return kept


def quality_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """Metrics and verdict for each row of ``docs`` (doc_id, text).

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept. base_failed: fewer than 50 words, or
    more than half of the words within repeated 3-word windows. kept: not
    base_failed, and within every bound of ``rules``.

    A null or empty text has no words and fails. Each row is judged by
    itself, so repeated rows get equal verdicts; an empty table gives an
    empty result. There is no shuffle.
    """
    df = measures(docs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
