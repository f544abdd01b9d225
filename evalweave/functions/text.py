"""Text helpers with Python's meaning of whitespace, tokens and numbers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points Python's strip() and split() treat as whitespace.
WHITESPACE = "".join(
    chr(point)
    for point in (
        *range(0x09, 0x0E),
        *range(0x1C, 0x21),
        0x85,
        0xA0,
        0x1680,
        *range(0x2000, 0x200B),
        0x2028,
        0x2029,
        0x202F,
        0x205F,
        0x3000,
    )
)
_SPACE = r"\s\x1c-\x1f"
BLANKS = rf"(?U)[{_SPACE}]++"
_BLANKS_IN_LINE = rf"(?U)[{_SPACE}&&[^\n]]++"
_AROUND_BREAK = rf"(?U)[{_SPACE}&&[^\n]]*+(\n)[{_SPACE}]*+|([{_SPACE}&&[^\n]]++)"

# The spellings Python's float() accepts (ASCII digits).
_DIGITS = r"[0-9](?:_?[0-9])*+"
FLOAT_PATTERN = (
    rf"(?i)\A[+-]?(?:(?:(?:{_DIGITS})(?:\.(?:{_DIGITS})?)?|\.(?:{_DIGITS}))"
    rf"(?:e[+-]?(?:{_DIGITS}))?|inf(?:inity)?|nan)\z"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def tokens(text: Column) -> Column:
    """Whitespace-separated tokens, none empty.

    Blanks are unified first: splitting at a single character needs no pattern,
    while ``split`` compiles one again for every row.
    """
    return F.array_remove(F.split(F.regexp_replace(text, BLANKS, " "), " "), "")


def filled_lines(text: Column) -> Column:
    """Lines that are not empty, as they are."""
    return F.array_remove(F.split(text, "\n"), "")


def kept_lines(text: Column) -> Column:
    """Lines that are not empty before stripping, each stripped."""
    return F.transform(filled_lines(text), strip)


def trimmed_lines(text: Column) -> Column:
    """The text's stripped, non-empty lines, as one text.

    A run of blanks is matched once, whole, with or without a line break in it.
    """
    return strip(F.regexp_replace(text, _AROUND_BREAK, "$1$2"))


def spaced_lines(text: Column) -> Column:
    """Like ``trimmed_lines`` with single spaces between tokens."""
    return strip(F.regexp_replace(F.regexp_replace(text, _BLANKS_IN_LINE, " "), r" ?\n[ \n]*+", "\n"))


def characters(text: Column) -> Column:
    return F.array_remove(F.split(text, ""), "")


def parse_float(text: Column) -> Column:
    """The double Python's float() gives, or null where it would raise."""
    bare = F.when(text.contains("_"), F.replace(text, F.lit("_"), F.lit(""))).otherwise(text)
    return F.when(text.rlike(FLOAT_PATTERN), bare.try_cast("double"))


def is_close(a: Column, b: Column) -> Column:
    """allclose on one pair: rtol 1e-5, atol 1e-8; null counts as not close."""
    infinity = F.lit(float("inf"))
    near = (F.abs(b) < infinity) & (F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(b))
    return F.coalesce(~F.isnan(a) & ~F.isnan(b) & ((a == b) | near), F.lit(False))


def all_close(left: Column, right: Column) -> Column:
    """Equal length and every pair close; the shorter side is filled with nulls."""
    return F.forall(F.zip_with(left, right, is_close), lambda ok: ok)


def round_thousandths(x: Column) -> Column:
    """round(x, 3) as Python does it: nearest by exact binary value, ties to even.

    Spark rounds the printed decimal, which differs where the printed form ends
    in 5. The error of ``x * 1000`` is recovered by splitting ``x`` in two halves.
    """
    scaled = x * 1000.0
    high = x * 134217729.0 - (x * 134217729.0 - x)
    error = (high * 1000.0 - scaled) + (x - high) * 1000.0
    below = F.floor(scaled).cast("double")
    part = scaled - below
    up = (part > 0.5) | (
        (part == 0.5) & ((error > 0.0) | ((error == 0.0) & (below % 2.0 != 0.0)))
    )
    # Beyond 2^43 doubles are coarser than a thousandth; adding 0 drops the sign of -0.
    whole = (x == F.rint(x)) | (F.abs(x) >= F.lit(float(2**43)))
    return F.when(whole, x + 0.0).otherwise((below + up.cast("double")) / 1000.0 + 0.0)
