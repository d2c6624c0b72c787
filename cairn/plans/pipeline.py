"""Named analyses, chains of them, and the same analysis over several tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.storagelevel import StorageLevel

from ..functions.columns import AMOUNT_HINTS, DATE_HINTS, resolve_column, roles, with_role
from ..operators import anomalies, association, charts, cleaning, describe, findings, insights, models, profile, retention, segments, series, text
from ..sources import readers


def default_order(df: DataFrame) -> list[str]:
    """Date columns, then all others that can be sorted: an order of rows that names no column."""
    dates = with_role(df, "date")
    return [*dates, *[c for c, r in roles(df).items() if r in ("numeric", "text", "boolean") and c not in dates]] or df.columns[:1]


def pick(df: DataFrame, name: str | None, hints: Sequence[str], role: str, what: str) -> str:
    found = resolve_column(df, name, hints, role=role)
    if found is None:
        raise ValueError(f"{what} needs a {role} column")
    return found


def text_report(df: DataFrame, column: str | None = None) -> DataFrame:
    """(metric, value, text): statistics of a text column, by default the first, and its commonest words."""
    column = column or pick(df, None, (), "text", "text")
    words = text.common_words(df, column)
    return text.text_stats(df, column).select("metric", F.col("value").cast("long").alias("value"), F.lit(None).cast("string").alias("text")).unionByName(words.select(F.lit("common_word").alias("metric"), F.col("n").alias("value"), F.col("word").alias("text")))


def forecast(df: DataFrame, target: str | None = None, *, date: str | None = None, key: str | None = None, periods: int = 5, level: float = 0.95) -> DataFrame:
    """(period, forecast, low, high): of ``target``, by default a column whose name speaks of amounts, else the last numeric one, over the first date column."""
    date = date or pick(df, None, DATE_HINTS, "date", "a forecast")
    numeric = [c for c in with_role(df, "numeric") if c != date]
    hinted = [c for c in numeric if c.lower() in AMOUNT_HINTS]
    if not numeric:
        raise ValueError("a forecast needs a numeric column")
    target = target if target in numeric else (hinted or numeric)[-1]
    return models.forecast_interval(df, target, date, key or next((c for c in df.columns if c not in (date, target)), date), periods, level=level)


def keyed(df: DataFrame, key: str | None = None) -> str:
    return key or df.columns[0]


#: Every action by name; each takes a table and its own arguments.
ANALYSES: dict[str, Callable[..., DataFrame]] = {
    "summary": lambda df, order_by=None, **a: summary(df, order_by or default_order(df), **a),
    "describe": describe.describe, "stats": describe.describe, "nulls": describe.nulls_by_column, "correlation": describe.correlation_pairs, "unique": describe.unique_counts,
    "head": lambda df, order_by=None, n=10: readers.head(df, n, order_by or default_order(df)),
    "overview": describe.overview, "metrics": describe.key_metrics, "profile": profile.column_profile, "duplicates": profile.duplicate_analysis,
    "quality": profile.quality, "recommendations": profile.recommendations, "summary_insights": insights.summary_insights,
    "chart": charts.auto_chart, "predict": models.predict, "forecast": forecast,
    "insights": lambda df, order_by=None: insights.insights(df, order_by or default_order(df)),
    "report": lambda df, order_by=None: insights.report(df, order_by or default_order(df)),
    "anomalies": anomalies.anomalies_summary, "text": text_report,
    "upload_profile": lambda df, order_by=None, **a: upload_profile(df, order_by or default_order(df), **a),
    "quality_issues": findings.quality_issues, "heatmap": association.heatmap, "chart_choice": association.chart_choice,
    "segments": lambda df, key=None, **a: segments.segments(df, keyed(df, key), **a),
    "growth": lambda df, date=None, value=None, **a: series.growth(df, date or pick(df, None, DATE_HINTS, "date", "growth"), value, **a),
    "seasonality": lambda df, date=None, value=None, **a: series.seasonality(df, date or pick(df, None, DATE_HINTS, "date", "seasonality"), value, **a),
    "retention": lambda df, user=None, date=None, **a: retention.retention(df, keyed(df, user), date or pick(df, None, DATE_HINTS, "date", "retention"), **a),
}

#: The steps of a run that names none.
DEFAULT_STEPS = ("clean", "summary", "insights")


class Results(dict):
    """Results by step. They are lazy and read the cleaned table, which is kept until :meth:`release` or the end of a ``with`` block."""

    def __init__(self) -> None:
        super().__init__()
        self.kept: list[DataFrame] = []

    def release(self) -> None:
        for df in self.kept:
            df.unpersist()
        self.kept.clear()

    def __enter__(self) -> Results:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()


def run(df: DataFrame, steps: Sequence[str] = DEFAULT_STEPS, cleaning_steps: Sequence[cleaning.Step] = cleaning.V1, *, arguments: dict[str, dict] | None = None) -> Results:
    """Results by step. After ``clean`` the steps see the cleaned table, which is kept while they run; its report is ``clean_report``.

    ``arguments`` has keyword arguments by step, such as ``{"forecast": {"target": "sales", "periods": 3}}``. An unknown step gives a summary. A step that the table has no columns
    for raises its ValueError, once the tables kept so far are released.
    """
    out = Results()
    try:
        for step in steps:
            given = (arguments or {}).get(step, {})
            if step == "clean":
                df, out["clean_report"] = cleaning.clean(df, cleaning_steps, kept=out.kept)
                df = df.persist(StorageLevel.MEMORY_AND_DISK)
                out.kept.append(df)
                out["clean"] = df
            else:
                out[step] = ANALYSES.get(step, ANALYSES["summary"])(df, **given)
    except Exception:
        out.release()
        raise
    return out


def steps_report(results: dict[str, DataFrame]) -> DataFrame:
    """(step, section, item, metric, value, text): every result of a run as one table, but for the cleaned rows. A result of other columns gives an entry for each cell: the row's number, the column and the value as text."""
    parts = []
    for step, rows in results.items():
        if step == "clean":
            continue
        if step == "clean_report":
            made = rows.select(F.col("step").alias("section"), F.col("column").alias("item"), F.col("action").alias("metric"), F.col("n").cast("double").alias("value"), F.lit(None).cast("string").alias("text"))
        elif tuple(rows.columns) == PROFILE:
            made = rows
        elif {"kind", "column", "metric", "value", "text"} <= set(rows.columns):
            made = rows.select(F.col("kind").alias("section"), F.col("column").alias("item"), "metric", "value", "text")
        else:
            made = cells(rows, step, [F.col(f"`{c}`").asc_nulls_first() for c in rows.columns], None)
        parts.append(made.select(F.lit(step).alias("step"), *PROFILE))
    return reduce(DataFrame.unionByName, parts)


def over_tables(tables: dict[str, DataFrame], analysis: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One analysis over every table, with ``table_name``."""
    return reduce(DataFrame.unionByName, [analysis(df).withColumn("table_name", F.lit(name)) for name, df in tables.items()])


PROFILE = ("section", "item", "metric", "value", "text")


def entries(df: DataFrame, section: str, item, metric, value=None, text=None) -> DataFrame:
    """Rows of (section, item, metric, value, text); strings are column names, other values are taken as they are."""
    col = lambda x: F.lit(x) if x is None else F.col(x) if isinstance(x, str) else x
    return df.select(F.lit(section).alias("section"), col(item).cast("string").alias("item"), col(metric).cast("string").alias("metric"), col(value).cast("double").alias("value"), col(text).cast("string").alias("text"))


def cells(df: DataFrame, section: str, order_by: Sequence, n: int | None) -> DataFrame:
    """The first ``n`` rows by ``order_by`` (all rows of a report without ``n``), one entry for each cell: the row's number, the column and the value as text."""
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order_by))  # of n rows
    rows = (df if n is None else df.orderBy(*order_by).limit(n)).withColumn("_row", number)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("text")) for c in df.columns])
    return entries(rows.select("_row", F.explode(pairs).alias("c")).select("_row", "c.*"), section, "_row", "column", None, "text")


def summary(df: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    """(section, item, metric, value, text): shape, types, statistics of numeric and of text columns, missing cells, and the first ``n`` rows by ``order_by``."""
    shape = describe.overview(df).where("metric in ('rows', 'columns')")
    types = df.limit(1).agg(F.count(F.lit(1))).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype")) for c, t in df.dtypes])).alias("d")).select("d.*")
    parts = [
        entries(shape, "shape", None, "metric", "value"),
        entries(types, "dtypes", "column", F.lit("dtype"), None, "dtype"),
        entries(describe.nulls_by_column(df), "nulls", "column", F.lit("n_null"), "n_null"),
        cells(df, "head", order_by, n),
    ]
    if with_role(df, "numeric"):
        parts.append(entries(describe.describe(df), "describe", "column", "stat", "value"))
    if with_role(df, "text"):
        parts += categories(df, "describe")
    return reduce(DataFrame.unionByName, parts)


def categories(df: DataFrame, section: str) -> list[DataFrame]:
    """Entries of the number of values of each text column, and of its commonest with its count."""
    top = describe.categorical_profile(df)
    return [entries(top, section, "column", F.lit("unique"), "n_categories"), entries(top, section, "column", F.lit("top"), "top_n", "top_value")]


def upload_profile(df: DataFrame, order_by: Sequence[str], *, preview: int = 20) -> DataFrame:
    """(section, item, metric, value, text): all that is said of a new table.

    Overview, columns (type, missing cells, distinct values), numeric and text columns, repeats, quality before and after cleaning with what the
    cleaning did, recommendations, and the first ``preview`` rows by ``order_by``. The report is made now, from the table and its groups of whole rows, which are kept
    meanwhile and released.
    """
    kept = [df.persist(StorageLevel.MEMORY_AND_DISK)]
    try:
        groups = describe.grouped(df, df.columns).persist(StorageLevel.MEMORY_AND_DISK)
        kept.append(groups)
        cleaned, done = cleaning.clean(df, cleaning.V2, kept=kept)
        columns = profile.column_profile(df)
        parts = [
            entries(describe.overview(df, groups), "overview", None, "metric", "value"),
            entries(columns.select("column", "dtype", F.explode(F.create_map(*[x for m in ("n_null", "pct", "n_unique") for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "value")), "columns", "column", "metric", "value", "dtype"),
            entries(profile.duplicate_analysis(df, groups=groups), "duplicates", None, "kind", "n"),
            entries(profile.quality(df, "clean", groups), "quality", None, F.lit("before"), "score"),
            entries(profile.quality(cleaned, "clean"), "quality", None, F.lit("after"), "score"),
            entries(done, "cleaning", "column", F.concat_ws(".", "step", "action"), "n"),
            entries(profile.recommendations(df, groups), "recommendations", "column", F.lit("priority"), "priority", "text"),
            cells(df, "preview", order_by, preview),
        ]
        if with_role(df, "numeric"):
            parts.append(entries(describe.describe(df), "numeric", "column", "stat", "value"))
        if with_role(df, "text"):
            parts += categories(df, "categorical")
        made = reduce(DataFrame.unionByName, parts)
        return df.sparkSession.createDataFrame(made.collect(), made.schema)  # some 30 entries for each column
    finally:
        for x in kept:
            x.unpersist()


def chart(df: DataFrame, kind: str | None = None, **arguments) -> DataFrame:
    """The series of a chart, of the kind and columns that fit the table unless given."""
    return charts.auto_chart(df, kind, **arguments)
