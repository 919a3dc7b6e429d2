"""Text, date and number expressions (SC-*). All stay inside whole-stage code generation or Catalyst's higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN_END = "9999-12-31"


def title_case(c: Column) -> Column:
    """Upper case after anything but a letter, lower case after a letter: o'neil mc-donald becomes O'Neil Mc-Donald (SC-2)."""
    n = F.length(c)
    before = lambda i: F.substring(c, i - 1, F.lit(1))
    piece = lambda i: F.when((i > 1) & F.lower(before(i)).rlike(r"\p{L}"), F.lower(F.substring(c, i, F.lit(1)))).otherwise(F.upper(F.substring(c, i, F.lit(1))))
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n), piece), "")).otherwise(c)


def text_or_empty(c: Column) -> Column:
    """Trimmed text; null is empty (SC-3)."""
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


def norm_text(c: Column) -> Column:
    """Trimmed lower case, for comparing categories (F-1)."""
    return F.lower(F.trim(c.cast("string")))


def concat_nonempty(*cols: Column, sep: str = " ") -> Column:
    """Join what is neither null nor blank (SC-9, P-11)."""
    return F.concat_ws(sep, *[F.nullif(F.trim(c), F.lit("")) for c in cols])


def as_date(c: Column) -> Column:
    """A date, or null if the text isn't one (SC-10)."""
    return F.expr("cast(null as date)") if c is None else c.try_cast("date")


def as_int(c: Column, default: int | None = 0) -> Column:
    """Text as a whole number, cut towards zero; the default for what isn't a number (SC-14)."""
    n = c.cast("string").try_cast("double").try_cast("long")
    return n if default is None else F.coalesce(n, F.lit(default).cast("long"))


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """No less than low, no more than high (SC-15)."""
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def age_on(born: Column, on: Column) -> Column:
    """Whole years between two dates by the calendar; none is below zero (SC-12)."""
    before = F.date_format(on, "MMdd") < F.date_format(born, "MMdd")
    return F.greatest(F.year(on) - F.year(born) - before.cast("int"), F.lit(0))


def years_before(c: Column, years: Column | int) -> Column:
    """The same day some years earlier; 29 February becomes the 28th where it must (SC-13)."""
    n = F.lit(years) if isinstance(years, int) else years
    return F.add_months(c, (n * -12).cast("int"))


def interval_contains(start: Column, end: Column, day: Column) -> Column:
    """A closed interval holds a day; a null end is open (F-6)."""
    return start.isNotNull() & (start <= day) & (end.isNull() | (end >= day))


def stable_order(key: Column) -> list[Column]:
    """Sort columns: keys of digits alone come first, by value; others follow by text."""
    digits = key.rlike("^[0-9]+$")
    return [F.when(digits, 0).otherwise(1), F.when(digits, F.lpad(key, 20, "0")).otherwise(key)]
