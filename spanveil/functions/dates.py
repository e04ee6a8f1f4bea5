"""Dates in texts: parsing, equivalence, the project's shift, and writing back in the original's form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months in order.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
MAX_SHIFT = 1825


def month_number(name: Column) -> Column:
    """1 to 12 by Spanish name, setiembre too; else null."""
    name = F.lower(name)
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), name), F.lit(0)), F.when(name == "setiembre", 9)).cast("int")


def _made(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int")), "yyyy-MM-dd")


def parse(text: Column) -> Column:
    """A date at the front of the text, in words, d/m/y, d-m-y, y-m-d or y/m/d; null if there is none or no such day."""
    words = r"^\s*(?i)(\d{1,2})\s+de\s+(\p{L}+)\s+(?:de|del)\s+(\d{4})"
    day, year = r"^\s*(\d{1,2})[/-](\d{1,2})[/-](\d{4})", r"^\s*(\d{4})[/-](\d{1,2})[/-](\d{1,2})"
    g = lambda p, i: F.nullif(F.regexp_extract(text, p, i), F.lit(""))
    return F.coalesce(_made(g(words, 3), month_number(g(words, 2)), g(words, 1)), _made(g(year, 1), g(year, 2), g(year, 3)), _made(g(day, 3), g(day, 2), g(day, 1)))


def project_delta(project: Column) -> Column:
    """Days in -1825 to 1825 from the md5 of the project."""
    return (F.conv(F.substring(F.md5(project.cast("string")), 1, 8), 16, 10).cast("long") % (2 * MAX_SHIFT + 1) - MAX_SHIFT).cast("int")


def shift(date: Column, delta: Column, preserve_weekday: bool = False, preserve_month_day: bool = False) -> Column:
    out = F.date_add(date, delta)
    if preserve_month_day:
        same = F.try_to_date(F.format_string("%04d-%02d-%02d", F.year(out), F.month(date), F.dayofmonth(date)), "yyyy-MM-dd")
        out = F.coalesce(same, F.make_date(F.year(out), F.month(date), F.lit(28)))
    if preserve_weekday:
        # The nearest day of the same weekday, three days off at most.
        gap = F.pmod(F.weekday(date) - F.weekday(out), F.lit(7))
        out = F.date_add(out, F.when(gap > 3, gap - 7).otherwise(gap))
    return out


def written_like(date: Column, original: Column) -> Column:
    """In words, with slashes, year first or day first, as the original's front shows."""
    y, m, d = F.year(date), F.month(date), F.dayofmonth(date)
    name = F.element_at(F.array(*map(F.lit, MONTHS)), m)
    return (
        F.when(original.contains(" de "), F.format_string("%d de %s de %d", d, name, y))
        .when(original.contains("/"), F.format_string("%02d/%02d/%04d", d, m, y))
        .when(original.contains("-") & original.startswith("20"), F.format_string("%04d-%02d-%02d", y, m, d))
        .otherwise(F.format_string("%02d-%02d-%04d", d, m, y))
    )


def plausible(day: Column, month: Column) -> Column:
    """1 to 31 and 1 to 12, month lengths aside."""
    return day.between(1, 31) & month.between(1, 12)


def days_in_month(year: Column, month: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))


def equivalence_key(text: Column) -> Column:
    """The parsed date, or the text where it is none: equal keys share an alias."""
    return F.coalesce(parse(text).cast("string"), text)


def roman(text: Column) -> Column:
    """Value of a Roman numeral; null for other letters."""
    worth = F.create_map(*[F.lit(x) for pair in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in pair])
    letters = F.split(F.reverse(F.upper(text)), "")
    fold = F.aggregate(letters, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("top")), lambda a, c: F.struct((a["sum"] + F.when(worth[c] < a["top"], -worth[c]).otherwise(worth[c])).alias("sum"), F.greatest(a["top"], worth[c]).alias("top")))
    return F.when(F.upper(text).rlike("^[IVXLCDM]+$"), fold["sum"])
