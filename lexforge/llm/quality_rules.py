"""Operator 8: quality rules. A threshold table compiled into one Spark projection: length, symbol,
stop-word, line and repetition measures, no user functions, no shuffle.

Row by row: null text counts as empty (0 words: it fails), repeated rows stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, narrow

#: (name, measure, lowest, highest): a document is kept if every measure lies in its bounds. The
#: bounds leave plain prose of 20 words or more alone (stop words are asked for from 200 words on).
RULES: list[tuple[str, str, float | None, float | None]] = [
    ("length", "n_words", 20, None),
    ("word_length", "mean_word_length", 2, 20),
    ("symbols", "symbols_per_word", None, 0.5),
    ("stop_words", "stop_words", 1, None),
    ("duplicate_lines", "duplicate_line_share", None, 0.5),
    ("repetition", "repeat_share", None, 0.3),
]
#: Frequent function words of the corpus languages.
STOP_WORDS = "the of and to in is that it was for on are as with by at be this der die das und ist von den mit zu sich ein eine nicht auf le la les de des et un une est que pour dans qui par sur el los las y en del se por con una para".split()
WINDOW = 8


def repeated_words(words: Column) -> Column:
    """Words inside windows of 8 that occur twice or more. Texts without a repeated window, most of
    them, cost one pass; else equal windows become neighbours by a sort of (hash, position)."""

    def over(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(h[i + k] for k in range(WINDOW))))

        def tell(w: Column) -> Column:
            def pairs(s: Column) -> Column:
                last = F.size(s) - 1
                again = F.filter(F.sequence(F.lit(0), last), lambda i: ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["h"] == s[i]["h"])) | ((i < last) & (s[F.least(i + 1, last)]["h"] == s[i]["h"])))
                places = F.sort_array(F.transform(again, lambda i: s[i]["at"]))
                state = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n"))
                return F.aggregate(places, state, lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(WINDOW), p - a["at"])).alias("n")), lambda a: a["n"])

            return F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(let(F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("at")))), pairs))

        return let(windows, tell)

    return F.when(F.size(words) <= WINDOW, 0).otherwise(let(F.transform(words, lambda x: F.xxhash64(x)), over)).cast("bigint")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, counts and ratios."""
    text = F.col("text")
    split = docs.select("doc_id", "text", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n_words = F.size("words").cast("bigint")
    counted = split.select(
        "doc_id",
        n_words.alias("n_words"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        let(lines, F.size).cast("bigint").alias("n_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size(F.array_intersect("words", F.array(*map(F.lit, STOP_WORDS)))).cast("bigint").alias("n_stop_words"),
    )
    per_word = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("n_words")), F.lit(0.0))
    return counted.select(
        "*",
        per_word("word_chars").alias("mean_word_length"),
        per_word("n_symbols").alias("symbols_per_word"),
        F.when(F.col("n_words") < 200, 1).otherwise(F.col("n_stop_words")).alias("stop_words"),
        F.coalesce(F.try_divide(F.col("n_dup_lines").cast("double"), F.col("n_lines")), F.lit(0.0)).alias("duplicate_line_share"),
        per_word("n_repeat_words").alias("repeat_share"),
    )


def quality_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, counts, base_failed, kept, failed (names of broken rules, comma-joined)."""
    broken = []
    for name, c, low, high in rules:
        bad = F.lit(False)
        if low is not None:
            bad = bad | (F.col(c) < low)
        if high is not None:
            bad = bad | (F.col(c) > high)
        broken.append(F.when(bad, F.lit(name)))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    m = measures(narrow(docs)).select("*", base.alias("base_failed"), F.concat_ws(",", *broken).alias("failed"))
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("failed") == "")).alias("kept"), "failed")
