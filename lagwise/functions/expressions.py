"""Column expressions shared by the operators: rounding, text, numbers, calendar."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(c: Column, digits: int) -> Column:
    """Scale, round half to even, scale back: the rule numpy and pandas use."""
    scale = float(10**digits)
    return F.rint(c * scale) / scale + F.lit(0.0)


def round_stable(c: Column, digits: int) -> Column:
    """Half-even rounding for floating sums and means.

    A first pass eight digits further out absorbs the noise that depends on the order of
    additions, so the outcome at a tie does not depend on partitioning.
    """
    return F.rint(F.rint(c * float(10 ** (digits + 8))) / 1e8) / float(10**digits) + F.lit(0.0)


# Fixed value: the characters that count as white space at the ends of a text.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2002\u2003\u2009\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    trimmed = strip(c)
    return F.when(F.length(trimmed) > 0, trimmed)


# Fixed value: the shape of a finite decimal number.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def tolerant_double(c: Column) -> Column:
    """Text to double; anything that is not a finite number becomes NULL."""
    text = strip(c)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def tolerant_int(c: Column) -> Column:
    """Text to int by way of double, so `12.7` gives 12; NULL when unreadable or out of range."""
    return tolerant_double(c).try_cast("int")


# The date texts of feeds. Month comes before day; two digits of a year from 69 on mean the last century.
ISO_DATE = "^[0-9]{4}(-[0-9]{1,2}){0,2}([ T].*)?$"
CLOCK = "( (([01]?[0-9]|2[0-3])(:[0-5][0-9]){1,2}|(0?[1-9]|1[0-2])(:[0-5][0-9]){1,2} [AaPp][Mm]))?"
MONTH_FIRST = "^([0-9]{1,2})([/-])([0-9]{1,2})\\2([0-9]{4})" + CLOCK + "$"
YEAR_FIRST = "^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})" + CLOCK + "$"
DIGITS_ONLY = "^([0-9]{4})([0-9]{2})([0-9]{2})$"
SHORT_YEAR = "^([0-9]{1,2})([/-])([0-9]{1,2})\\2"
NAMED_MONTH = "^([A-Za-z]{3,9} [0-9]{1,2},|[0-9]{1,2} [A-Za-z]{3,9}) [0-9]{4}$"
MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
]


def text_to_date(c: Column) -> Column:
    """Date or datetime text to a date; NULL when unreadable, as is a time without a date.

    ISO text is cast. Numeric texts are rewritten as ISO (`3/5/2024 8:30 AM`, `3-5-2024`, `2024/3/5`, `20240305`, `3/5/24`), as
    are texts with an English month (`Mar 5, 2024`, `5 March 2024`). Every text is parsed once.
    """
    text = strip(c)
    names = {n: i + 1 for i, month in enumerate(MONTHS) for n in (month, month[:3])}
    numbers = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.lit(str(i)) for i in names.values())))
    name = F.lower(F.regexp_extract(text, "[A-Za-z]+", 0))
    day = F.regexp_extract(text, "(^| )([0-9]{1,2})[, ]", 2)
    written = F.concat_ws("-", F.right(text, F.lit(4)), F.try_element_at(numbers, name), day)
    numeric = text
    for shape, iso in (
        (MONTH_FIRST, "$4-$1-$3"), (YEAR_FIRST, "$1-$2-$3"), (DIGITS_ONLY, "$1-$2-$3"),
        (SHORT_YEAR + "([0-5][0-9]|6[0-8])$", "20$4-$1-$3"), (SHORT_YEAR + "(69|[7-9][0-9])$", "19$4-$1-$3"),
    ):
        numeric = F.regexp_replace(numeric, shape, iso)
    # Longer runs of digits would pass for years.
    readable = text.rlike("^[0-9]{1,4}[/-]|^[0-9]{8}$")
    iso = F.when(readable, numeric).when(text.rlike(NAMED_MONTH), written)
    return F.when(text.rlike(ISO_DATE), F.to_date(F.try_to_timestamp(text))).otherwise(iso.try_cast("date"))


# First month of each season.
SEASON_BY_MONTHS = {"winter": [12, 1, 2], "spring": [3, 4, 5], "summer": [6, 7, 8], "fall": [9, 10, 11]}


def season_of(month: Column) -> Column:
    out = F.lit(None).cast("string")
    for season, months in SEASON_BY_MONTHS.items():
        out = F.when(month.isin(months), F.lit(season)).otherwise(out)
    return out


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.when(condition, 1).otherwise(0)


def neg_log10_p(p: Column, floor: float = 1e-10) -> Column:
    return -F.log10(F.greatest(p, F.lit(floor)))


def day_number(date: Column) -> Column:
    return F.datediff(date, F.lit("1970-01-01").cast("date"))


def complete(columns) -> Column:
    """True where none of the columns is NULL or NaN.

    One check per column, not one function of all of them: the optimizer rewrites a condition
    once per combination of the aliases it mentions, which is exponential for a wide one.
    """
    checks = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in columns]
    return reduce(lambda a, b: a & b, checks)


def correlation(x: str, y: str) -> Column:
    """Aggregate: pairwise-complete correlation, NULL where either side does not vary.

    The built-in one raises on zero variance under ANSI rules.
    """
    a = F.when(F.col(y).isNotNull(), F.col(x))
    b = F.when(F.col(x).isNotNull(), F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
