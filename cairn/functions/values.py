"""Scalar expressions: missing values, numbers, dates, time windows."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import roles

#: Texts that stand for a missing cell.
MISSING = ("", "NA", "N/A", "NULL", "null", "NaN", "nan", "None")
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")


def canonical_nulls(df: DataFrame) -> DataFrame:
    """NaN and the texts of MISSING become NULL."""
    types = dict(df.dtypes)
    out = {}
    for c, role in roles(df).items():
        if types[c] in ("double", "float"):
            out[c] = F.when(~F.isnan(c), F.col(c))
        elif role == "text":
            out[c] = F.when(~F.trim(c).isin(*MISSING), F.col(c))
    return df.withColumns(out) if out else df


def to_number(c: Column | str) -> Column:
    """A number, NULL where the text is none."""
    return F.expr(f"try_cast(`{c}` as double)") if isinstance(c, str) else c.try_cast("double")


def currency_number(c: Column) -> Column:
    """A number after removal of currency signs and thousands commas."""
    return F.regexp_replace(c, "[₹$€,]", "").try_cast("double")


def looks_numeric(c: Column) -> Column:
    return F.regexp_replace(c, "[₹$€,]", "").rlike(r"^-?\d+(\.\d+)?$")


def date_shape(pattern: str) -> str:
    """A regular expression that every text of a date pattern fits from its beginning: digits for numbers, any text for names."""
    parts = re.findall(r"'([^']*)'|(([A-Za-z])\3*)|([^A-Za-z'])", pattern)
    number = lambda run: run[0] in "yuMdHhmsS" and not (run[0] == "M" and len(run) > 2)
    return "".join((("[+-]?" if run[0] in "yu" else "") + "[0-9]+" if number(run) else ".+") if run else re.escape(quoted or other or "'") for quoted, run, _, other in parts)


def to_date(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """A timestamp by the first format that fits, else NULL. Only texts of a format's shape are parsed, as each parse that fails is dear."""
    shaped = c.cast("string").rlike(rf"^\s*({'|'.join(map(date_shape, formats))})")
    return F.when(shaped, F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats]))


def amount_of(text: Column) -> Column:
    """Signed amount of a statement line: the number after ``Rs.``, negative for paid."""
    plain = F.regexp_replace(text, ",", "")
    value = F.regexp_extract(plain, r"(?i)rs\.?\s*(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(flow_of(text) == "paid", -value).otherwise(value)


def flow_of(text: Column) -> Column:
    """received or paid by the sign before ``Rs.``; NULL without one."""
    sign = F.regexp_extract(F.regexp_replace(text, ",", ""), r"(?i)([+-])\s*rs", 1)
    return F.when((sign == "+") | F.ltrim(text).startswith("+"), "received").when(sign == "-", "paid")


def day_month(text: Column, year: Column) -> Column:
    """Date of a line such as ``05 Aug`` or ``05 Aug'24``; ``year`` fills in. NULL for impossible days."""
    day = F.regexp_extract(text, r"^(\d{1,2})\s+[A-Za-z]{3,}", 1)
    month = F.initcap(F.substring(F.regexp_extract(text, r"^\d{1,2}\s+([A-Za-z]{3,})", 1), 1, 3))
    own = F.regexp_extract(text, r"'(\d{2})\s*$", 1)
    full = F.when(own != "", F.concat(F.lit("20"), own)).otherwise(year.cast("string"))
    return F.try_to_timestamp(F.concat_ws("-", day, month, full), F.lit("d-MMM-yyyy")).cast("date")


def time_window(preset: str, as_of: dt.date) -> tuple[dt.date, dt.date]:
    """Days [start, end) of a preset relative to ``as_of``; weeks begin on Mondays."""
    day, one = as_of, dt.timedelta(days=1)
    week = day - dt.timedelta(days=day.weekday())
    month = day.replace(day=1)
    quarter = day.replace(month=3 * ((day.month - 1) // 3) + 1, day=1)
    year = day.replace(month=1, day=1)
    back = lambda d, n: (d.replace(day=1) - dt.timedelta(days=1)).replace(day=1) if n == 1 else back(back(d, 1), n - 1)
    windows = {
        "today": (day, day + one), "yesterday": (day - one, day),
        "this_week": (week, week + 7 * one), "last_week": (week - 7 * one, week),
        "this_month": (month, (month + 32 * one).replace(day=1)), "last_month": (back(month, 1), month),
        "this_quarter": (quarter, (quarter + 95 * one).replace(day=1)), "last_quarter": (back(quarter, 3), quarter),
        "this_year": (year, year.replace(year=year.year + 1)), "last_year": (year.replace(year=year.year - 1), year),
        "last_7_days": (day - 6 * one, day + one), "last_30_days": (day - 29 * one, day + one), "last_90_days": (day - 89 * one, day + one), "past_year": (day - 364 * one, day + one),
    }
    return windows[preset]


def in_range(date: str, start: dt.date, end: dt.date) -> Column:
    """start <= date < end, as literals that reach the Parquet scan."""
    return (F.col(date) >= F.lit(start)) & (F.col(date) < F.lit(end))


def in_month(date: str, month: int, year: int | None = None) -> Column:
    """The month of one year as a range; without a year of any."""
    if year is None:
        return F.month(date) == month
    return in_range(date, dt.date(year, month, 1), dt.date(year + month // 12, month % 12 + 1, 1))
