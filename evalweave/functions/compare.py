"""Tiers that decide whether a program's output matches the expected text.

``effective`` tiers reproduce the scores of the reference's comparison as it
runs; the other tiers do what its comments intend. Sets of sets are compared as
sorted, distinct strings: tokens hold no whitespace, so joining them by a space
loses nothing and lets duplicates be removed by hashing.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalweave.functions import text

# Cheap tests that rule a tier out before any array is built.
DIGITS_AND_BLANKS = r"(?U)\A[\s\x1c-\x1f0-9]*+\z"
NUMBERS_AND_BLANKS = r"(?Ui)\A[\s\x1c-\x1f0-9.e+_infaty-]*+\z"
TWO_CHARACTERS = r"(?U)[^\s\x1c-\x1f]{2}"


def _set(values: Column) -> Column:
    return F.sort_array(F.array_distinct(values))


def _set_text(values: Column) -> Column:
    return F.array_join(_set(values), " ")


def _rounded_set_text(values: Column, unusable: str) -> Column:
    """Like ``_set_text`` on rounded numbers; ``unusable`` stands for a text that is none."""
    numbers = F.transform(values, text.parse_float)
    spelled = F.transform(
        numbers,
        lambda x: F.when(x.isNull() | F.isnan(x), F.lit(unusable)).otherwise(
            text.round_thousandths(x).cast("string")
        ),
    )
    return _set_text(spelled)


def _sets_of(pieces: Column, members, encode) -> Column:
    return _set(F.transform(pieces, lambda p: encode(members(p))))


def exact(actual: Column, expected: Column) -> Column:
    return text.strip(actual) == text.strip(expected)


def digits_close(actual: Column, expected: Column) -> Column:
    """Every character of the output is a digit close to the expected line."""
    return actual.rlike(r"\A[0-9]*\z") & text.all_close(
        F.transform(text.characters(actual), lambda c: c.try_cast("double")),
        F.transform(text.kept_lines(expected), text.parse_float),
    )


def _holds_first(actual: Column, expected: Column) -> Column:
    """Whether the output's first character stands in the expected text too; so for an output without any."""
    return expected.contains(F.substring(text.strip(actual), 1, 1))


def charset(actual: Column, expected: Column) -> Column:
    """Each output token, as a set of characters, is the token set of a line.

    So no expected token may be longer than one character, and every character of the output is one.
    """
    return _holds_first(actual, expected) & ~expected.rlike(TWO_CHARACTERS) & (
        _sets_of(text.tokens(actual), text.characters, _set_text)
        == _sets_of(text.filled_lines(expected), text.tokens, _set_text)
    )


def charset_rounded(actual: Column, expected: Column) -> Column:
    """The same on rounded numbers: the output's are its digits, one by one.

    A number spelled in digits alone rounds to no digit but its last.
    """

    def digits(token: Column) -> Column:
        return F.transform(text.characters(token), lambda c: F.concat(c, F.lit(".0")))

    return (
        actual.rlike(DIGITS_AND_BLANKS)
        & expected.rlike(NUMBERS_AND_BLANKS)
        & (_holds_first(actual, expected) | ~expected.rlike(DIGITS_AND_BLANKS))
        & (
            _sets_of(text.tokens(actual), digits, _set_text)
            == _sets_of(text.filled_lines(expected), text.tokens, _expected_numbers)
        )
    )


def lines(actual: Column, expected: Column) -> Column:
    return text.trimmed_lines(actual) == text.trimmed_lines(expected)


def _both_numeric(actual: Column, expected: Column) -> Column:
    return actual.rlike(NUMBERS_AND_BLANKS) & expected.rlike(NUMBERS_AND_BLANKS)


def numeric(actual: Column, expected: Column) -> Column:
    return _both_numeric(actual, expected) & text.all_close(
        F.transform(text.tokens(actual), text.parse_float),
        F.transform(text.tokens(expected), text.parse_float),
    )


def _line_sets(value: Column, encode) -> Column:
    """Distinct token sets of the lines of ``text.spaced_lines``."""
    return _sets_of(F.array_remove(F.split(value, "\n"), ""), lambda x: F.split(x, " "), encode)


def unordered(actual: Column, expected: Column) -> Column:
    a, e = text.spaced_lines(actual), text.spaced_lines(expected)
    return (a == e) | (_line_sets(a, _set_text) == _line_sets(e, _set_text))


def _actual_numbers(values: Column) -> Column:
    return _rounded_set_text(values, "no number here")


def _expected_numbers(values: Column) -> Column:
    return _rounded_set_text(values, "no number there")


def rounded(actual: Column, expected: Column) -> Column:
    a, e = text.spaced_lines(actual), text.spaced_lines(expected)
    return _both_numeric(actual, expected) & (
        _line_sets(a, _actual_numbers) == _line_sets(e, _expected_numbers)
    )


TIERS = {
    "exact": exact,
    "digits_close": digits_close,
    "charset": charset,
    "charset_rounded": charset_rounded,
    "lines": lines,
    "numeric": numeric,
    "unordered": unordered,
    "rounded": rounded,
}
MODES = {
    "effective": ("exact", "digits_close", "charset", "charset_rounded"),
    "strict": ("exact", "lines", "numeric"),
    "intent": ("exact", "lines", "numeric", "unordered", "rounded"),
}


def matches(tier: str, actual: Column, expected: Column) -> Column:
    return F.coalesce(TIERS[tier](actual, expected), F.lit(False))


def first_tier(actual: Column, expected: Column, mode: str = "strict") -> Column:
    """Name of the first tier of ``mode`` that matches, else null.

    The branches are evaluated in order, so the array tiers only run for rows
    the cheaper tiers left undecided.
    """
    first, *rest = MODES[mode]
    chain = F.when(matches(first, actual, expected), F.lit(first))
    for tier in rest:
        chain = chain.when(matches(tier, actual, expected), F.lit(tier))
    return chain


def outputs_match(actual: Column, expected: Column, mode: str = "strict") -> Column:
    return first_tier(actual, expected, mode).isNotNull()
