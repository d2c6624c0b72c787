"""Cleaning steps and the two pipelines made of them. Counters are taken before a step changes anything."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.columns import DATE_HINTS, roles, standardise_names, with_role
from ..functions.values import currency_number, looks_numeric, to_date, to_number
from .anomalies import iqr_counts, zscore_counts
from .describe import categorical_profile, melt, stats_row

ACTIONS = "step string, column string, action string, n long"
Step = Callable[[DataFrame], tuple[DataFrame, DataFrame | None]]


def actions(counted: DataFrame, step: str, action: str) -> DataFrame:
    """Report rows of (column, n)."""
    return counted.where("n > 0").select(F.lit(step).alias("step"), "column", F.lit(action).alias("action"), F.col("n").cast("long").alias("n"))


def counted(df: DataFrame, step: str, action: str, n: dict[str | None, int]) -> DataFrame:
    """Report rows of counts that a scan has brought to the driver, one for each column."""
    return df.sparkSession.createDataFrame([(step, c, action, k) for c, k in n.items() if k], ACTIONS)


def numeric_enough(row, ratio: float) -> bool:
    return bool(row["n"]) and row["number"] >= ratio * row["n"]


def tidy_text(df: DataFrame, *, ratio: float = 0.8) -> tuple[DataFrame, DataFrame | None]:
    """:func:`trim_text`, :func:`coerce_numbers` and :func:`coerce_dates` one after another, decided and counted in one scan of the table."""
    texts = with_role(df, "text")
    if not texts:
        return df, None
    plain = {c: F.trim(F.col(f"`{c}`")) for c in texts}
    dates = [c for c in texts if c.lower() in DATE_HINTS]
    row = df.agg(*[F.struct(
        F.count(plain[c]).alias("n"), F.count_if(F.col(f"`{c}`") != plain[c]).alias("trimmed"), F.count_if(looks_numeric(plain[c])).alias("number"),
        (F.count(to_date(plain[c])) if c in dates else F.lit(0)).alias("date")).alias(c) for c in texts]).first()
    made = {c: currency_number(plain[c]) if numeric_enough(row[c], ratio) else to_date(plain[c]) if row[c]["date"] else plain[c] for c in texts}
    return df.withColumns(made), counted(df, "trim", "trimmed", {c: row[c]["trimmed"] for c in texts})


def trim_text(df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Text without outer blanks; NULL stays NULL."""
    texts = with_role(df, "text")
    if not texts:
        return df, None
    row = df.agg(*[F.count_if(F.col(c) != F.trim(c)).alias(c) for c in texts])
    return df.withColumns({c: F.trim(c) for c in texts}), actions(melt(row, ("column", "n"), [(c, F.col(f"`{c}`")) for c in texts]), "trim", "trimmed")


def coerce_numbers(df: DataFrame, *, ratio: float = 0.8, columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Text columns become numbers where at least ``ratio`` of all their values are numbers, with or without currency signs."""
    texts = list(columns if columns is not None else with_role(df, "text"))
    if not texts:
        return df, None
    row = df.agg(*[F.struct(F.count(c).alias("n"), F.count_if(looks_numeric(F.col(c))).alias("number")).alias(c) for c in texts]).first()
    chosen = [c for c in texts if numeric_enough(row[c], ratio)]
    return df.withColumns({c: currency_number(F.col(c)) for c in chosen}) if chosen else df, None


def coerce_dates(df: DataFrame, *, columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Text columns with a date's name become timestamps if any value parses."""
    texts = [c for c in with_role(df, "text") if (c in columns if columns is not None else c.lower() in DATE_HINTS)]
    if not texts:
        return df, None
    row = df.agg(*[F.count(to_date(F.col(c))).alias(c) for c in texts]).first()
    return df.withColumns({c: to_date(F.col(c)) for c in texts if row[c]}), None


def to_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns as numbers, NULL where a text is none; outer blanks don't matter, currency signs and thousands commas do."""
    return df.withColumns({c: to_number(F.trim(F.col(f"`{c}`").cast("string"))) for c in columns})


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that have a value in all of ``columns`` (by default in every one); NaN is no value."""
    return df.dropna(subset=list(columns or df.columns))


def fix_types(df: DataFrame, *, min_number_ratio: float = 1.0, min_date_ratio: float = 0.0) -> tuple[DataFrame, DataFrame | None]:
    """A text column becomes numbers if enough values are, else timestamps if enough (by default any) parse."""
    texts = with_role(df, "text")
    if not texts:
        return df, None
    row = df.agg(*[F.struct(F.count(c).alias("n"), F.count(F.col(c).try_cast("double")).alias("k"), F.count(to_date(F.col(c))).alias("d")).alias(c) for c in texts]).first()
    out = {}
    for c in texts:
        n, k, d = row[c]["n"], row[c]["k"], row[c]["d"]
        if n and k >= min_number_ratio * n:
            out[c] = F.col(c).try_cast("double")
        elif d and d >= min_date_ratio * n:
            out[c] = to_date(F.col(c))
    return df.withColumns(out) if out else df, None


def drop_duplicates(df: DataFrame, kept: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Distinct rows, and how many went. The rows are grouped once: they are kept (memory, then disk) for the steps that follow, and put into ``kept`` for who releases them."""
    groups = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n")).persist(StorageLevel.MEMORY_AND_DISK)
    if kept is not None:
        kept.append(groups)
    n = groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n"))
    return groups.drop("_n"), actions(n.select(F.lit(None).cast("string").alias("column"), "n"), "duplicates", "removed")


def fillers(df: DataFrame, numeric: Sequence[str], texts: Sequence[str]) -> dict:
    """The median of numeric columns, the commonest value of text columns (ties: the smallest); both by counts, so no task holds all values of a column."""
    out = {}
    if numeric:
        row = stats_row(df, numeric).first()
        out |= {c: row[c]["p50"] for c in numeric}
    if texts:
        out |= {r["column"]: r["top_value"] for r in categorical_profile(df, texts).collect()}  # a row for each column
    return out


def impute(df: DataFrame, form: str = "v1") -> tuple[DataFrame, DataFrame | None]:
    """Numeric columns get the median, text the commonest value (ties: the smallest); dates stay.

    Where a column has no value at all, v1 fills 0 and "Unknown", v2 leaves numbers and fills "". Missing cells are counted first, and only columns that have some are looked at again.
    """
    r = {c: k for c, k in roles(df).items() if k in ("numeric", "text")}
    if not r:
        return df, None
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(f"`{c}`").alias(c) for c in r]).first()
    missing = {c: row["_rows"] - row[c] for c in r if row[c] < row["_rows"]}
    known = fillers(df, [c for c in missing if r[c] == "numeric"], [c for c in missing if r[c] == "text"])
    types = dict(df.dtypes)
    fill = {}
    for c in missing:
        value = known[c] if known.get(c) is not None else {"v1": {"numeric": 0.0, "text": "Unknown"}, "v2": {"numeric": None, "text": ""}}[form][r[c]]
        if value is not None:
            fill[c] = F.coalesce(F.col(c).cast("double"), F.lit(value)) if r[c] == "numeric" and types[c] in ("int", "bigint", "smallint", "tinyint") and value != int(value) else F.coalesce(F.col(c), F.lit(value).cast(types[c]))
    return df.withColumns(fill) if fill else df, counted(df, "impute", "filled", {c: missing[c] for c in fill})


def names_step(df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    return standardise_names(df), None


def z_step(df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    return df, actions(zscore_counts(df), "outliers", "flagged") if with_role(df, "numeric") else None


def iqr_step(df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    return df, actions(iqr_counts(df), "outliers", "flagged") if with_role(df, "numeric") else None


def impute_v2(df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    return impute(df, "v2")


V1: tuple[Step, ...] = (tidy_text, drop_duplicates, impute, z_step)
V2: tuple[Step, ...] = (names_step, impute_v2, drop_duplicates, fix_types, iqr_step)


def clean(df: DataFrame, steps: Sequence[Step] = V1, *, kept: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The cleaned table and (step, column, action, n); ``steps`` are callables from a table to a table and its report rows.

    Tables that are kept meanwhile go into ``kept``; ``unpersist`` them after the last use of the results.
    """
    reports = []
    for step in steps:
        df, report = step(df, kept) if step is drop_duplicates else step(df)
        if report is not None:
            reports.append(report)
    empty = df.sparkSession.createDataFrame([], ACTIONS)
    return df, reduce(DataFrame.unionByName, reports, empty)
