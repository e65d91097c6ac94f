"""Cleaning of text codes, flags, ages and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean "not filled in".
MISSING_CODES = ("", "NAN", "NONE")
#: Most years that a plain number of up to three digits may mean.
MAX_PLAIN_AGE = 130


def canonical(c: Column) -> Column:
    """Upper case without outer blanks; null becomes empty."""
    return F.upper(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def only_digits(c: Column) -> Column:
    """The digits of a text; null becomes empty."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[^0-9]", "")


def yes_no(c: Column) -> Column:
    """1 for code 1, 0 for codes 0 and 2, else unknown."""
    code = canonical(c)
    return F.when(code == "1", 1.0).when(code.isin("0", "2"), 0.0)


def indicator(c: Column, *accepted: str) -> Column:
    """1 if the code is among the accepted ones, 0 for any other, unknown where the code is missing."""
    code = canonical(c)
    return F.when(~code.isin(*MISSING_CODES), code.isin(*[a.strip().upper() for a in accepted]).cast("double"))


def age_years(c: Column) -> Column:
    """Years of a coded age: up to three digits are years; else unit (4 years, 3 months, 2 days, 1 hours) and amount."""
    digits = only_digits(c)
    plain = F.when(F.length(digits).between(1, 3), digits.cast("int"))
    coded = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
    amount = F.substring(coded, 2, 18).try_cast("double")
    unit = F.substring(coded, 1, 1)
    by_unit = F.when(unit == "4", amount).when(unit == "3", amount / 12.0).when(unit == "2", amount / 365.0).when(unit == "1", amount / 8760.0)
    return F.when(digits == "", None).when(plain <= MAX_PLAIN_AGE, plain.cast("double")).otherwise(by_unit)


def strict_date(c: Column) -> Column:
    """The date of a text YYYY-MM-DD; anything else, or no such day, is null."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def lenient_date(c: Column) -> Column:
    """Whatever Spark can read as a time stamp, as a date; else null."""
    return F.try_to_timestamp(c.cast("string")).cast("date")


def delay_days(later: Column, earlier: Column) -> Column:
    """Days from the earlier to the later date; may be negative, null unless both are known."""
    return F.datediff(later, earlier)


def without_sentinel(c: Column, sentinel: float = -9999) -> Column:
    return F.when(c != sentinel, c)


def decimal_comma(c: Column) -> Column:
    """A number written with a decimal comma; null if it is none."""
    return F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")


def looks_dated(c: Column) -> Column:
    """Text that is filled and starts with four digits."""
    return c.isNotNull() & c.rlike(r"^\d{4}")


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(c) & ~F.abs(c).eqNullSafe(F.lit(float("inf"))), c)
