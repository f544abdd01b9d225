"""Comparison of call results recorded as JSON text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# A JSON string, a JSON number, or the text between them.
_PIECE = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9][0-9.eE+-]*+|[^"0-9-]++'
# Where a spelling may differ from the plain one.
_UNUSUAL = r"[0-9][.eE]|-0"
# Whole numbers below this have a decimal that holds them; longer ones are read as floats.
_DECIMALS = 1e38
_LIMB = 2.0**53


def _whole(value: Column) -> Column:
    """The digits of a whole double, exactly, from its parts below powers of 2**53."""
    low = value % _LIMB
    rest = (value - low) / _LIMB
    middle = rest % _LIMB
    high = (rest - middle) / _LIMB
    unit = F.lit(int(_LIMB)).cast("decimal(16,0)")
    parts = [part.cast("long").cast("decimal(38,0)") for part in (high, middle, low)]
    return ((parts[0] * unit + parts[1]) * unit + parts[2]).cast("string")


def _plain_number(piece: Column) -> Column:
    value = piece.try_cast("double")
    whole = (value == F.rint(value)) & (F.abs(value) < _DECIMALS)
    return (
        F.when(piece.rlike(r"\A-?[0-9]+\z"), F.when(piece == "-0", F.lit("0")).otherwise(piece))
        .when(whole, _whole(value))
        .otherwise(value.cast("string"))
    )


def canonical(value: Column, booleans_as_numbers: bool = False) -> Column:
    """One spelling per JSON value (a variant): sorted keys, no blanks, numbers by value.

    ``1``, ``1.0`` and ``1e0`` agree, at any size up to 38 digits. With ``booleans_as_numbers`` so do ``true``
    and ``1``.
    """
    ordered = F.to_json(value)

    def respell(piece: Column) -> Column:
        other = piece
        if booleans_as_numbers:
            other = F.replace(
                F.replace(piece, F.lit("true"), F.lit("1")), F.lit("false"), F.lit("0")
            )
        return (
            F.when(piece.startswith('"'), piece)
            .when(piece.rlike(r"\A-?[0-9]"), _plain_number(piece))
            .otherwise(other)
        )

    pieces = F.regexp_extract_all(ordered, F.lit(_PIECE), F.lit(0))
    respelled = F.array_join(F.transform(pieces, respell), "")
    unusual = _UNUSUAL + ("|true|false" if booleans_as_numbers else "")
    return F.when(ordered.rlike(unusual), respelled).otherwise(ordered)


def calls_match(actual: Column, expected: Column, mode: str = "strict") -> Column:
    """The result equals the expected value or the expected list's first element.

    Text that is not JSON matches nothing.
    """
    loose = mode == "effective"
    wanted = F.try_parse_json(expected)
    first = F.try_variant_get(wanted, "$[0]", "variant")
    result = canonical(F.try_parse_json(actual), loose)
    accepted = F.array(canonical(wanted, loose), canonical(first, loose))
    return F.coalesce(F.array_contains(accepted, result), F.lit(False))
