"""Column expressions that clean string-typed staging values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that guard casts, and the accepted date layouts in order.
INTEGER = r"^-?[0-9]+$"
UNSIGNED = r"^[0-9]+$"
NUMERIC = r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
LOOSE_NUMERIC = r"^-?[0-9]+\.?[0-9]*$"
SLASH_DATE = r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$"
DASH_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
DATE_LAYOUTS = (  # pattern, where year, month and day start
    (SLASH_DATE, (7, 4, 1)),
    (DASH_DATE, (1, 6, 9)),
    (r"^[0-9]{2}-[0-9]{2}-[0-9]{4}$", (7, 4, 1)),
    (SLASH_DATE, (7, 1, 4)),
    (r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$", (1, 6, 9)),
    (r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$", (7, 4, 1)),
)


_SPACES = " \t\n\x0b\f\r\u00a0"


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(col_of(c)), F.lit(""))


def guarded(c: Column | str, dtype: str = "int", pattern: str = INTEGER) -> Column:
    """Cast where the trimmed text matches the pattern, else NULL."""
    text = blank_to_null(c)
    return F.when(text.rlike(pattern), text.try_cast(dtype))


def number_text(c: Column | str) -> Column:
    """Locale number text: no spaces of any kind, a dot as decimal sign."""
    return F.translate(blank_to_null(c), "," + _SPACES, ".")


def clean_long(c: Column | str) -> Column:
    """Rounded to the nearest integer (half to even), NULL when it is no number."""
    text = number_text(c)
    return F.when(text.rlike(NUMERIC), F.rint(text.try_cast("double")).try_cast("bigint"))


def clean_decimal(c: Column | str) -> Column:
    return number_text(c).try_cast("decimal(38,10)")


def _day(text: Column, starts: tuple[int, int, int]) -> Column:
    """The date in a fixed-width text, NULL when there is no such day.

    Cutting and casting costs a fraction of a formatter, and bad days raise nothing.
    """
    year, month, day = starts
    parts = [F.substring(text, year, 4), F.substring(text, month, 2), F.substring(text, day, 2)]
    return F.concat_ws("-", *parts).try_cast("date")


def parse_date(c: Column | str) -> Column:
    """dd/MM/yyyy or yyyy-MM-dd, else NULL."""
    text = blank_to_null(c)
    return F.when(text.rlike(SLASH_DATE), _day(text, (7, 4, 1))).when(text.rlike(DASH_DATE), text.try_cast("date"))


def normalise_date(c: Column | str) -> Column:
    """Six layouts and ISO timestamps -> dd/MM/yyyy; anything else stays as it was."""
    raw = col_of(c)
    text = F.trim(raw)
    tries = [F.when(text.rlike(pattern), _day(text, starts)) for pattern, starts in DATE_LAYOUTS]
    head = F.substring(text, 1, 10)
    tries.append(F.when(text.contains("T") & head.rlike(DASH_DATE), head.try_cast("date")))
    return F.coalesce(F.date_format(F.coalesce(*tries), "dd/MM/yyyy"), raw)


def near_zero(c: Column | str) -> Column:
    """Values smaller than one in size count as zero; so does NULL."""
    c = col_of(c)
    zero = F.lit(0).cast("decimal(38,10)")
    return F.when(c.isNull() | (F.abs(c) < 1), zero).otherwise(c)


def is_blank(c: Column | str) -> Column:
    c = col_of(c)
    return c.isNull() | (c == "")


def repair_customers() -> dict[str, tuple[Column, Column]]:
    """Column -> (rows to repair, replacement)."""
    zero = F.lit("0")
    return {
        "nationalite": (is_blank("nationalite") | F.col("nationalite").rlike(LOOSE_NUMERIC), F.col("residence")),
        "chiffreaffaires": (is_blank("chiffreaffaires") | ~F.col("chiffreaffaires").rlike(INTEGER), zero),
        "douteux": (is_blank("douteux") | ~F.col("douteux").rlike(INTEGER), zero),
    }
