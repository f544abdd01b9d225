"""Line-first quality rules, in DataFrame functions only.

Lines are judged first: too few words or mostly separators (navigation), no mark
that ends a sentence (punctuation), stock phrases, shouting or strings of
symbols (boilerplate). Failing lines are removed, and a document that loses too
much of its text that way is rejected, as is one that fails the base rules.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_WORDS = 3
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MIN_LINE_WORDS = 3
# A line with a symbol for every so many characters is navigation or markup.
CHARACTERS_PER_SYMBOL = 16
# Percent of a document's characters that must be left.
MIN_KEPT_PERCENT = 60

# White space, symbols, marks that end a sentence, stock phrases.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
SYMBOL_CLASS = r"[#*$%&|<>]"
END_CLASS = r"[.!?:;…。！？]"
CLOSING_CLASS = r"[\"')\]”’»]"
PHRASES = [
    "lorem ipsum",
    "javascript",
    "cookie policy",
    "use of cookies",
    "privacy policy",
    "terms of use",
    "terms of service",
    "all rights reserved",
    "powered by",
    "skip to content",
    "share this",
    "subscribe to",
]


def _symbols(text: Column) -> Column:
    """Symbols in ``text``; the costly count only where there is one."""
    count = F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOL_CLASS, ""))
    return F.when(text.rlike(SYMBOL_CLASS), count).otherwise(F.lit(0))


def line_fails(line: Column, min_line_words: int = MIN_LINE_WORDS) -> Column:
    """Whether a line that has a word is to be removed."""
    enough = r"\A" + SPACE_CLASS + "*" + WORD_CLASS + "+"
    enough += f"(?:{SPACE_CLASS}+{WORD_CLASS}+){{{min_line_words - 1}}}"
    navigation = ~line.rlike(enough) | (_symbols(line) * CHARACTERS_PER_SYMBOL > F.char_length(line))
    punctuation = ~line.rlike(f"{END_CLASS}{CLOSING_CLASS}*(?:{SPACE_CLASS}|$)")
    shouting = ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}{2}")
    lowered = F.lower(line)
    boilerplate = shouting
    for phrase in PHRASES:
        boilerplate = boilerplate | lowered.contains(phrase)
    return punctuation | navigation | boilerplate


def _repeated_words(rows: DataFrame) -> DataFrame:
    """Add ``repeated``: words covered by a window whose words occur twice or more.

    Windows are compared by a 64-bit hash, in sorted order, so a text of n words
    takes n log n steps.
    """
    size = F.size("words")
    last = size - WINDOW_WORDS + 1
    windows = F.transform(
        F.slice("words", F.lit(1), F.greatest(last, F.lit(0))),
        lambda word, i: F.struct(
            F.xxhash64(word, *[F.get("words", i + k) for k in range(1, WINDOW_WORDS)]).alias("h"),
            i.alias("i"),
        ),
    )
    at = F.sort_array(
        F.transform(
            F.filter(
                "sorted",
                lambda x, i: (x["h"] == F.get("sorted", i - 1)["h"])
                | (x["h"] == F.get("sorted", i + 1)["h"]),
            ),
            lambda x: x["i"],
        )
    )
    covered = F.aggregate(
        F.transform(
            "at",
            lambda p, i: F.least(F.lit(WINDOW_WORDS), F.coalesce(F.get("at", i + 1) - p, F.lit(WINDOW_WORDS))),
        ),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    sorted_rows = rows.select("*", F.sort_array(windows).alias("sorted"))
    return sorted_rows.select("*", at.alias("at")).select("*", covered.alias("repeated"))


def judged(
    docs: DataFrame,
    min_kept_percent: int = MIN_KEPT_PERCENT,
    min_line_words: int = MIN_LINE_WORDS,
) -> DataFrame:
    """Each row of ``docs`` as ``row``, with its counts, ``cleaned`` text and verdict.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
    n_removed_lines, base_failed, kept. A null text counts as empty, so it fails
    the base rules. Rows are judged one by one: repeated rows and null ids give
    the same verdicts, an empty table gives no rows, and other columns, of any
    name, ride along in ``row``.
    """
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    has_word = lambda line: line.rlike(WORD_CLASS)
    trimmed = F.trim("text", F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, SPACE_CLASS + "+")
    )
    rows = (
        docs.select(F.struct("*").alias("row"))
        .select("row", text.alias("text"))
        .select("*", words.alias("words"), F.filter(F.split("text", "\n"), has_word).alias("lines"))
    )
    counted = _repeated_words(rows).select(
        "row",
        "lines",
        F.filter("lines", lambda line: ~line_fails(line, min_line_words)).alias("good"),
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _symbols(F.col("text")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.col("repeated").alias("n_repeat_words"),
    )
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )
    enough = 100 * F.char_length("cleaned") >= min_kept_percent * F.char_length(F.array_join("lines", "\n"))
    return (
        counted.select("*", F.array_join("good", "\n").alias("cleaned"))
        .select(
            "row",
            "cleaned",
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size("good")).cast("long").alias("n_removed_lines"),
            base_failed.alias("base_failed"),
            (~base_failed & enough).alias("kept"),
        )
    )


def digests(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its id, counts and verdict."""
    return judged(docs).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "n_lines",
        "n_removed_lines",
        "base_failed",
        "kept",
    )


def clean(docs: DataFrame) -> DataFrame:
    """The documents that pass, without their failing and empty lines; ``n_chars`` is counted anew."""
    # A filter on computed columns alone would be pushed below them, with a copy of all
    # that they are computed from; one that reads a row number stays where it is.
    numbered = judged(docs).select("*", F.monotonically_increasing_id().alias("number"))
    found = numbered.filter("kept and number >= 0")
    renewed = {
        "text": F.col("cleaned").cast(docs.schema["text"].dataType),
    }
    if "n_chars" in docs.columns:
        renewed["n_chars"] = F.char_length("cleaned").cast(docs.schema["n_chars"].dataType)
    return found.select(*[renewed.get(name, F.col("row")[name]).alias(name) for name in docs.columns])
