"""Week texts and the three week calendars.

``jan4``: weeks start on Sunday and the one that holds 4 January is the first. ``iso``: the same with Monday.
``day_of_year``: year and day of year of the week's Sunday, 53 at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CALENDARS = ("jan4", "iso", "day_of_year")
#: Years and weeks that a week text may hold.
YEARS, WEEKS = (1900, 2100), (1, 53)


def sunday(d: Column) -> Column:
    return F.date_sub(d, F.dayofweek(d) - 1)


def first_sunday(year: Column) -> Column:
    """Start of week 1 of a year in the jan4 calendar."""
    return sunday(F.make_date(year, F.lit(1), F.lit(4)))


def week_of(d: Column, calendar: str = "jan4") -> Column:
    """Week of a date as text YYYYWW."""
    if calendar == "iso":
        return F.format_string("%04d%02d", F.extract(F.lit("YEAROFWEEK"), d), F.weekofyear(d))
    start = sunday(d)
    if calendar == "day_of_year":
        return F.format_string("%04d%02d", F.year(start), F.least(F.floor((F.dayofyear(start) - 1) / 7) + 1, F.lit(53)).cast("int"))
    if calendar != "jan4":
        raise ValueError(f"calendar must be one of {CALENDARS}")
    year = F.year(F.date_add(start, 3))
    return F.format_string("%04d%02d", year, (F.floor(F.datediff(start, first_sunday(year)) / 7) + 1).cast("int"))


def week_start(week: Column, calendar: str = "jan4") -> Column:
    """First day of a week YYYYWW: Sunday (jan4) or Monday (iso)."""
    year, number = F.substring(week, 1, 4).try_cast("int"), F.substring(week, 5, 2).try_cast("int")
    jan4 = F.make_date(year, F.lit(1), F.lit(4))
    first = F.date_sub(jan4, F.weekday(jan4)) if calendar == "iso" else sunday(jan4)
    return F.date_add(first, 7 * (number - 1))


def week_number(week: Column, calendar: str = "jan4") -> Column:
    """A running number of the week YYYYWW, one higher from week to week, also over a year of 53."""
    return F.floor(F.datediff(week_start(week, calendar), F.lit("1970-01-01").cast("date")) / 7)


def _number(text: Column, at: int, size: int) -> Column:
    return F.substring(text, at, size).try_cast("int")


def _reading(year: Column, week: Column, years: tuple[int, int]) -> Column:
    """A struct of year and week, null unless both are in range."""
    return F.when(year.between(*years) & week.between(*WEEKS), F.struct(year.alias("y"), week.alias("w")))


def _text(reading: Column) -> Column:
    return F.when(reading.isNotNull(), F.format_string("%04d%02d", reading["y"], reading["w"]))


def parse_week(df: DataFrame, column: str, name: str, preferred_year: Column | None = None) -> DataFrame:
    """df with the week text of a column as YYYYWW, or null, under ``name``.

    Anything from a dot on is cut and other signs but digits are dropped. Six digits may be YYYYWW or WWYYYY, five YYYYW
    or WYYYY. With both readings valid, the one in the preferred year wins, then the one closest to it within a year
    (the smaller week if equally close), then the week-first reading of six and the year-first reading of five digits.
    The steps stand in projections of their own, so that no step's expression is repeated inside the next.
    """
    digits = F.regexp_replace(F.substring_index(F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))), ".", 1), "[^0-9]", "")
    out = df.withColumn("__g", digits).withColumn("__n", F.length("__g"))
    six, five, g = F.col("__n") == 6, F.col("__n") == 5, F.col("__g")
    number = lambda a, m, b, n: F.when(six, _number(g, a, m)).when(five, _number(g, b, n))
    out = out.withColumns({"__y1": number(1, 4, 1, 4), "__w1": number(5, 2, 5, 1), "__y2": number(3, 4, 2, 4), "__w2": number(1, 2, 1, 1), "__p": F.lit(None).cast("int") if preferred_year is None else preferred_year})
    # How far a valid reading's year is from the preferred one; far without a preference, null if not valid.
    off = lambda k: F.when(F.col(f"__y{k}").between(*YEARS) & F.col(f"__w{k}").between(*WEEKS), F.coalesce(F.abs(F.col(f"__y{k}") - F.col("__p")), F.lit(9999)))
    out = out.withColumns({"__o1": off(1), "__o2": off(2)})
    o1, o2 = F.col("__o1"), F.col("__o2")
    near = F.least(o1, o2) <= 1
    earlier = (o1 > 0) & (F.col("__w2") < F.col("__w1"))
    second = F.when(o1.isNull() | o2.isNull(), o1.isNull()).when(near & (o1 != o2), o2 < o1).when(near, earlier).otherwise(six)
    out = out.withColumn("__s", second)
    week = F.format_string("%04d%02d", F.when(F.col("__s"), F.col("__y2")).otherwise(F.col("__y1")), F.when(F.col("__s"), F.col("__w2")).otherwise(F.col("__w1")))
    return out.withColumn(name, F.when(o1.isNotNull() | o2.isNotNull(), week)).drop("__g", "__n", "__y1", "__w1", "__y2", "__w2", "__p", "__o1", "__o2", "__s")


def parse_week_six(c: Column) -> Column:
    """Exactly six digits: YYYYWW, else WWYYYY, else null."""
    text = F.trim(c.cast("string"))
    ok = text.rlike(r"^\d{6}$")
    return F.when(ok, F.coalesce(_text(_reading(_number(text, 1, 4), _number(text, 5, 2), YEARS)), _text(_reading(_number(text, 3, 4), _number(text, 1, 2), YEARS))))


def parse_week_short(c: Column, years: tuple[int, int] = (2000, 2026)) -> Column:
    """Three to six digits, two-digit years in the short forms; null outside the years."""
    text = F.substring_index(F.trim(c.cast("string")), ".", 1)
    n = F.length(text)
    read = lambda y, w: _text(_reading(y, w, years))
    six = F.coalesce(read(_number(text, 1, 4), _number(text, 5, 2)), read(_number(text, 3, 4), _number(text, 1, 2)))
    five = F.coalesce(read(_number(text, 2, 4), _number(text, 1, 1)), read(_number(text, 1, 4), _number(text, 5, 1)))
    four = read(2000 + _number(text, 3, 2), _number(text, 1, 2))
    three = read(2000 + _number(text, 2, 2), _number(text, 1, 1))
    return F.when(~text.rlike(r"^\d+$"), None).when(n == 6, six).when(n == 5, five).when(n == 4, four).when(n == 3, three)


def six_digits(c: Column) -> Column:
    """The text if it is six digits, without a range check; else null."""
    return F.when(c.rlike(r"^\d{6}$"), c)


def derive_week(df: DataFrame, fields: list[tuple[str, str, str]], dates: list[tuple[str, str]], source_year: str, calendar: str = "jan4", order: list[str] | None = None, names: tuple[str, str] = ("week", "week_origin")) -> DataFrame:
    """df with a week and the name of where it comes from, by precedence.

    fields: (name, week text column, date column); dates: (name, date column). A field's week is read with the year of
    its date preferred, or the source year; a date's week by the calendar, named with the suffix ``_week``. A week counts
    only if its year is within one of the source year. order: names in another precedence (default: all fields, then all
    dates).
    """
    out, found = df, []
    for name, text, day in fields:
        out = parse_week(out, text, f"__week_{name}", F.coalesce(F.year(day), F.col(source_year)))
        found.append(name)
    for name, day in dates:
        out = out.withColumn(f"__week_{name}_week", F.when(F.col(day).isNotNull(), week_of(F.col(day), calendar)))
        found.append(f"{name}_week")
    fits = {n: F.when(F.abs(F.substring(f"__week_{n}", 1, 4).try_cast("int") - F.col(source_year)) <= 1, F.col(f"__week_{n}")) for n in found}
    out = out.withColumns({f"__fit_{n}": c for n, c in fits.items()})
    ranked = order or found
    origin = F.coalesce(*[F.when(F.col(f"__fit_{n}").isNotNull(), F.lit(n)) for n in ranked])
    out = out.withColumns({names[0]: F.coalesce(*[F.col(f"__fit_{n}") for n in ranked]), names[1]: origin})
    return out.drop(*[f"__week_{n}" for n in found], *[f"__fit_{n}" for n in found])


def season(number: Column) -> tuple[Column, Column]:
    """Sine and cosine of the week's place in a year of 52 weeks."""
    angle = number.cast("double") * F.lit(2) * F.pi() / 52.0
    return F.sin(angle), F.cos(angle)
