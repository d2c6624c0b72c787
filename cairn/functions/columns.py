"""Roles and names of columns: pure functions of a schema, no job."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Column names that hint at a meaning.
AMOUNT_HINTS = ("amount", "value", "total", "price", "credit", "debit")
DATE_HINTS = ("date", "datetime", "transaction_date", "time", "timestamp", "month", "year")
CATEGORY_HINTS = ("category", "type", "tag", "group", "description", "name")


def roles(df: DataFrame) -> dict[str, str]:
    """Each column's role: numeric, text, date, boolean or other."""
    kinds = ((T.BooleanType, "boolean"), (T.NumericType, "numeric"), (T.StringType, "text"), ((T.DateType, T.TimestampType, T.TimestampNTZType), "date"))
    return {f.name: next((role for kind, role in kinds if isinstance(f.dataType, kind)), "other") for f in df.schema}


def with_role(df: DataFrame, role: str) -> list[str]:
    return [c for c, r in roles(df).items() if r == role]


def resolve_column(df: DataFrame, explicit: str | None = None, hints: Sequence[str] = (), take: str = "first", role: str | None = "numeric") -> str | None:
    """``explicit`` by exact, then lower-case, then partial name; else a hinted name (the first or last); else the first column of ``role``."""
    lower = {c.lower(): c for c in df.columns}
    if explicit is not None:
        if explicit.lower() in lower:
            return lower[explicit.lower()]
        return next((c for low, c in lower.items() if explicit.lower() in low or low in explicit.lower()), None)
    hinted = [c for low, c in lower.items() if low in hints]
    if hinted:
        return hinted[0 if take == "first" else -1]
    return next(iter(with_role(df, role)), None) if role else None


def standard_names(names: Sequence[str]) -> list[str]:
    """Trimmed, lower case, blanks to underscores, only letters, digits and underscores; collisions get _2, _3, ..."""
    out: list[str] = []
    for n in names:
        base = re.sub(r"[^0-9a-zA-Z_]", "", n.strip().lower().replace(" ", "_")) or "column"
        name, k = base, 1
        while name in out:
            k += 1
            name = f"{base}_{k}"
        out.append(name)
    return out


def standardise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*standard_names(df.columns))
