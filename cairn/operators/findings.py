"""What is wrong with a table, most severe first; and column sketches that merge.

One aggregate looks at all columns. Distinct values come from a sketch; only columns that the sketch puts near a rule's limit are counted exactly, in a second aggregate.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import DATE_HINTS, roles
from ..functions.values import MISSING, looks_numeric, to_date
from .describe import grouped

SEVERITIES = ("critical", "warning", "informational")
#: Words of a column's name whose values can't be negative.
POSITIVE_WORDS = ("price", "quantity", "qty", "units", "count", "age", "size", "weight", "height", "length", "width", "distance", "duration", "stock", "population", "total")
#: Shares of a column, or of the rows, from which a finding is critical or a warning.
MISSING_CRITICAL, MISSING_WARNING, REPEATS_CRITICAL = 0.5, 0.2, 0.2
#: A text column of at least LEAST_VALUES values is of high cardinality from that share of distinct ones on; of a wrong type from that share of numbers on; dates from that share of dates on.
LEAST_VALUES, HIGH_CARDINALITY, NUMBERS, DATES = 20, 0.9, 0.8, 0.5
#: Relative error of the distinct sketch, and how many of them a rule's limit is kept away from it.
SKETCH_ERROR, MARGIN = 0.02, 4
EARLIEST = dt.date(1900, 1, 1)


def can_not_be_negative(name: str) -> bool:
    words = re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).lower())
    return any(name.lower().endswith(w) or w in words for w in POSITIVE_WORDS)


def scan(df: DataFrame, as_of: dt.date | None):
    """The first aggregate: one row, a struct for each column."""
    whole = F.count(F.lit(1)).alias("_rows")
    parts = []
    for name, role in roles(df).items():
        c = F.col(f"`{name}`")
        known = F.nanvl(c.cast("double"), F.lit(None).cast("double")).isNotNull() if dict(df.dtypes)[name] in ("float", "double") else c.isNotNull()
        fields = [F.count_if(known).alias("n")]
        if role in ("numeric", "text", "date", "boolean"):
            v = F.when(known, c)
            fields += [F.approx_count_distinct(v, SKETCH_ERROR).alias("distinct"), (F.min(v).eqNullSafe(F.max(v)) & (F.count_if(known) > 0)).alias("constant")]
        if role == "numeric":
            fields.append(F.count_if(c < 0).alias("negative"))
        if role == "text":
            fields += [F.count_if(F.trim(c).isin(*MISSING)).alias("placeholder"), F.count_if(looks_numeric(F.trim(c))).alias("number"), F.count_if(to_date(F.trim(c)).isNotNull()).alias("date"), F.count_if(c != F.trim(c)).alias("blank")]
        if role == "date":
            fields += [F.count_if(c.cast("date") < F.lit(EARLIEST)).alias("early"), (F.count_if(c.cast("date") > F.lit(as_of)) if as_of else F.lit(0).cast("long")).alias("late")]
        parts.append(F.struct(*fields).alias(name))
    return df.agg(whole, *parts).first()


def exact_distinct(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    return df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(c) for c in columns]).first().asDict() if columns else {}


def quality_issues(df: DataFrame, *, as_of: dt.date | None = None, digits: int = 2) -> DataFrame:
    """(priority, severity, kind, column, n, pct, text): findings, priority 1 (critical) to 3 (informational).

    Missing cells (NaN among them) and their placeholders, empty and constant columns, repeated rows, negative values where the column's name
    speaks against it, dates that don't parse beside others that do, dates before 1900 or after ``as_of``, numbers kept as text, outer blanks, and texts
    that are nearly all different. ``pct`` is of all rows for missing cells and repeats, else of the column's values. No finding gives an empty table.
    """
    row = scan(df, as_of)
    rows = row["_rows"]
    found: list[tuple] = []

    def add(severity: str, kind: str, column: str | None, n: int, of: int, text: str) -> None:
        found.append((SEVERITIES.index(severity) + 1, severity, kind, column, n, round(100.0 * n / of, digits) if of else 0.0, text))

    near_limit = []
    for name, role in roles(df).items():
        c = row[name].asDict()
        n, missing = c["n"], rows - c["n"]
        if rows and not n:
            add("critical", "empty_column", name, missing, rows, f"{name} has no values")
            continue
        if missing:
            share = missing / rows
            add("critical" if share >= MISSING_CRITICAL else "warning" if share >= MISSING_WARNING else "informational", "missing", name, missing, rows, f"{name} has {missing} missing cells")
        if c.get("constant") and n > 1:
            add("warning", "constant", name, n, n, f"{name} has one value")
        if role == "numeric" and c["negative"] and can_not_be_negative(name):
            add("critical", "negative", name, c["negative"], n, f"{name} has {c['negative']} negative values")
        if role == "date":
            for kind, words in (("early", f"before {EARLIEST.year}"), ("late", f"after {as_of}")):
                if c[kind]:
                    add("warning", f"{kind}_date", name, c[kind], n, f"{name} has {c[kind]} dates {words}")
        if role != "text" or not n:
            continue
        if c["placeholder"]:
            add("warning", "placeholder", name, c["placeholder"], n, f"{name} has {c['placeholder']} texts that stand for a missing cell")
        if c["number"] >= NUMBERS * n:
            add("warning", "numbers_as_text", name, c["number"], n, f"{name} keeps numbers as text")
        elif c["date"] == n:
            add("informational", "dates_as_text", name, n, n, f"{name} keeps dates as text")
        elif c["date"] >= DATES * n or c["date"] and name.lower() in DATE_HINTS:
            add("critical" if c["date"] < DATES * n else "warning", "invalid_date", name, n - c["date"], n, f"{name} has {n - c['date']} texts that are no dates")
        if c["blank"]:
            add("informational", "outer_blanks", name, c["blank"], n, f"{name} has {c['blank']} texts with outer blanks")
        if n >= LEAST_VALUES and c["distinct"] >= (1 - MARGIN * SKETCH_ERROR) * HIGH_CARDINALITY * n:
            near_limit.append((name, n))
    exact = exact_distinct(df, [name for name, _ in near_limit])
    for name, n in near_limit:
        if exact[name] >= HIGH_CARDINALITY * n:
            add("informational", "high_cardinality", name, exact[name], n, f"{name} has {exact[name]} different texts")
    repeats = grouped(df, df.columns).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n")).first()["n"] if rows else 0
    if repeats:
        add("critical" if repeats >= REPEATS_CRITICAL * rows else "warning", "repeated_rows", None, repeats, rows, f"{repeats} rows repeat others")
    found.sort(key=lambda f: (f[0], -f[5], f[2], f[3] or ""))  # a few for each column
    return df.sparkSession.createDataFrame(found, "priority int, severity string, kind string, column string, n long, pct double, text string")


def column_sketches(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """(by..., column, n, n_null, low, high, sketch) of each part of a table: what :func:`merged_profile` makes the profile of any union of parts from.

    A part is scanned once and never again; sketches have a bounded size. ``low`` and ``high`` are of numbers and dates, as numbers.
    """
    kinds = roles(df)
    columns = list(columns or [c for c in df.columns if c not in by])
    number = lambda c: F.unix_micros(F.col(f"`{c}`").cast("timestamp")).cast("double") / 1e6 if kinds[c] == "date" else F.col(f"`{c}`").cast("double") if kinds[c] == "numeric" else F.lit(None).cast("double")
    structs = [F.struct(F.count(f"`{c}`").alias("n"), (F.count(F.lit(1)) - F.count(f"`{c}`")).alias("n_null"), F.min(number(c)).alias("low"), F.max(number(c)).alias("high"), F.hll_sketch_agg(F.col(f"`{c}`").cast("string")).alias("sketch")).alias(c) for c in columns]
    row = df.groupBy(*by).agg(*structs)
    each = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}`.{f}").alias(f) for f in ("n", "n_null", "low", "high", "sketch")]) for c in columns])
    return row.select(*by, F.explode(each).alias("_c")).select(*by, "_c.*")


def merged_profile(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, n, n_null, pct_null, low, high, distinct): the profile over the parts of a group, without their rows; ``distinct`` is the merged sketch's estimate."""
    made = parts.groupBy(*by, "column").agg(F.sum("n").alias("n"), F.sum("n_null").alias("n_null"), F.min("low").alias("low"), F.max("high").alias("high"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))
    return made.select(*by, "column", "n", "n_null", F.round(F.try_divide(F.col("n_null") * 100.0, F.col("n") + F.col("n_null")), 2).alias("pct_null"), "low", "high", "distinct")
