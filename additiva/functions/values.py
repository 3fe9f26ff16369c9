"""Scalar rules of the score model as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A dosage is stored in units of 1/16384.
DOSAGE_UNIT = 16384
#: Variants in a scoring tile.
TILE = 2000
#: Variants in a block of the variant index.
BLOCK = 100_000

_NUMBER = r"^[\t-\r ]*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number(text: Column) -> Column:
    """A finite decimal number that takes up the whole text, else null.

    Overflow and underflow to zero are rejected as well. Hexadecimal floats are not supported.
    """

    def parsed(t: Column) -> Column:
        tiny = F.regexp_extract(t, r"^[^eE]*", 0).rlike("[1-9]")
        kept = lambda v: F.when((F.abs(v) <= F.lit(1.7976931348623157e308)) & ((v != 0) | ~tiny), v)
        return F.when(t.rlike(_NUMBER), once(F.trim(t).try_cast("double"), kept))

    return once(text, parsed)


def once(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_upper(text: Column) -> Column:
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def is_missing(text: Column) -> Column:
    """``.``, or NA or NaN in any case."""
    return (text == ".") | ascii_upper(text).isin("NA", "NAN")


def allele_value(text: Column, alt: Column) -> Column:
    """The value of ``ALT=value`` or a plain value; null if it names another allele or several."""
    name = F.split_part(text, F.lit("="), F.lit(1))
    rest = F.substring_index(text, "=", -1)
    return F.when(text.contains(","), F.lit(None).cast("string")).when(text.contains("="), F.when((ascii_upper(name) == alt) & (F.size(F.split(text, "=")) == 2), rest)).otherwise(text)


def beta_alt(weight: Column, effect: Column, alt: Column) -> Column:
    """Weight of the ALT dosage: a REF effect turns w * (2 - x) into 2w - w * x."""
    return F.when(effect == alt, weight).otherwise(-weight)


def intercept(weight: Column, effect: Column, ref: Column) -> Column:
    return F.when(effect == ref, 2 * weight).otherwise(F.lit(0.0))


def dosage(fixed: Column) -> Column:
    """Stored fixed-point dosage to a number; null is missing."""
    return fixed / F.lit(float(DOSAGE_UNIT))


def fraction(part: Column, whole: Column) -> Column:
    """0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def stripped(text: Column, prefix: str) -> Column:
    """The text without a required prefix; null if it lacks it or nothing remains."""
    n = len(prefix)
    return F.when(text.startswith(prefix) & (F.length(text) > n), F.substring(text, n + 1, 2**31 - 1 - n))


def tile_of(ordinal: Column, block: int = BLOCK) -> Column:
    size = tile_size(block)
    return F.floor(ordinal / F.lit(size)).cast("long")


def tile_size(block: int = BLOCK) -> int:
    size = min(TILE, block)
    if block <= 0 or block % size:
        raise ValueError(f"block size {block} is not a multiple of the tile of {size}")
    return size


def general17(x: float) -> str:
    """Shortest form with 17 significant digits at most, as in C."""
    return "%.17g" % x
