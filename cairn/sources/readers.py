"""Reading tables by format, lines and delimited lines; writing results."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import canonical_nulls

FORMATS = {"csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "ndjson": "json", "txt": "text", "log": "text", "parquet": "parquet", "orc": "orc"}
DELIMITERS = (",", "\t", ";", "|")


def read(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:  # noqa: A002
    """A table by its extension or ``format``; missing cells become NULL."""
    ext = (format or os.path.splitext(path.rstrip("/"))[1].lstrip(".")).lower()
    if ext not in FORMATS:
        raise ValueError(f"unsupported format {ext!r}; supported: {', '.join(sorted(FORMATS))}")
    kind = FORMATS[ext]
    if kind == "csv":
        return canonical_nulls(spark.read.csv(path, header=True, inferSchema=True, sep="\t" if ext == "tsv" else ","))
    if kind == "json":
        return canonical_nulls(spark.read.json(path, multiLine=ext == "json"))
    if kind == "text":
        return read_text(spark, path)
    return canonical_nulls(spark.read.format(kind).load(path))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Stripped, non-blank lines: ``value`` if all are numbers, else ``line``."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")
    n, numbers = lines.agg(F.count(F.lit(1)), F.count(F.col("line").try_cast("double"))).first()
    if n == 0:
        raise ValueError(f"{path} has no text")
    return lines.select(F.col("line").cast("double").alias("value")) if n == numbers else lines


def read_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """A dataset of named Parquet tables."""
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def catalog_tables(spark: SparkSession, database: str | None = None, names: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The tables of a database in Spark's catalog (by default the current one), all or those named; views too."""
    found = [t.name for t in spark.catalog.listTables(database) if names is None or t.name in names]
    if not found:
        raise ValueError(f"no tables in {database or spark.catalog.currentDatabase()!r}")
    views = {t.name for t in spark.catalog.listTables(database) if t.isTemporary}
    return {n: spark.table(n if database is None or n in views else f"{database}.`{n}`") for n in sorted(found)}


def jdbc_tables(spark: SparkSession, url: str, names: Sequence[str], **options: str) -> dict[str, DataFrame]:
    """Named tables of a database behind JDBC, whose driver the session has; ``options`` may tell how to read in parallel (``partitionColumn`` and its bounds)."""
    return {n: spark.read.format("jdbc").options(url=url, dbtable=n, **options).load() for n in names}


def document_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, text): the stripped, non-blank lines of each document; ``line_no`` counts all lines from 0."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, r"\R")).alias("line_no", "text"))
    return lines.withColumn("text", F.trim("text")).where("text <> ''")


def page_lines(docs: DataFrame, id_col: str, text_col: str, *, separator: str = "\f") -> DataFrame:
    """(id, page, line_no, text): the stripped, non-blank lines of each page. Pages are numbered from 1 and end at a form feed, as text extraction leaves them, or at another ``separator``; ``line_no`` counts the page's lines from 0."""
    pages = docs.select(id_col, F.posexplode(F.split(text_col, "\\Q" + separator + "\\E")).alias("page", "_page"))
    lines = pages.select(id_col, (F.col("page") + 1).alias("page"), F.posexplode(F.split("_page", r"\R")).alias("line_no", "text"))
    return lines.withColumn("text", F.trim("text")).where("text <> ''")


def detect_delimiter(lines: DataFrame, col: str, probe: int = 20) -> str | None:
    """The first delimiter that gives the probed lines (any 20 that aren't NULL) one number of fields, two or more. A bounded look at the format."""
    head = [r[0] for r in lines.select(col).where(F.col(col).isNotNull()).limit(probe).collect()]
    return next((d for d in DELIMITERS if head and len(n := {len(x.split(d)) for x in head}) == 1 and min(n) >= 2), None)


def split_delimited(lines: DataFrame, col: str, delimiter: str | None = None) -> DataFrame:
    """Every line split into col_0, col_1, ..., as many as the longest line has; short and NULL lines give NULL. Without a delimiter the lines stay as they are."""
    delimiter = delimiter or detect_delimiter(lines, col)
    if delimiter is None:
        return lines.select(col)
    parts = F.split(col, "[" + delimiter + "]")
    n = max(0, lines.agg(F.max(F.size(parts))).first()[0] or 0)
    return lines.select(*[F.get(parts, F.lit(k)).alias(f"col_{k}") for k in range(n)])


def head(df: DataFrame, n: int = 10, order_by: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(*order_by).limit(n) if order_by else df.limit(n)


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:  # noqa: A002
    df.write.format(format).mode(mode).save(path)
