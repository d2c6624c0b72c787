"""Helpers of the text operators: scratch tables, row tags, normalisation."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of an Arrow batch for Python workers, beyond one row.
BATCH_BYTES = "8m"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Used only where the session names no shared folder and runs on one machine, as in tests.
FALLBACK_SCRATCH = "/tmp/cairn-scratch"


def scratch_folder(spark: SparkSession) -> str:
    """The application's part of the folder that all executors share: ``spark.checkpoint.dir`` of the session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        shared = FALLBACK_SCRATCH
    return f"{shared}/cairn/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the scratch folder."""
    return f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete the application's scratch tables. Results that aren't written yet still read them, so call it after the last write."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str, *, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table into the shared folder and read it back.

    Cuts lineage as a checkpoint does, and fixes values such as row tags, so that a
    later loss of an executor can't change them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wish: str, *others: str) -> str:
    """``wish``, with as many underscores behind it as make it a name that no column of ``df`` and none of ``others`` has."""
    taken = {c.lower() for c in (*df.columns, *others)}
    while wish.lower() in taken:
        wish += "_"
    return wish


def refuse(df_columns: Iterable[str], results: Iterable[str]) -> None:
    """A clear error for columns whose names the result needs for its own."""
    own = {c.lower() for c in results}
    if clash := sorted(c for c in df_columns if c.lower() in own):
        raise ValueError(f"the result has columns of its own called {clash}; rename those of the table")


def tagged(df: DataFrame, label: str, tag: str = "_tag") -> DataFrame:
    """``df`` in a scratch table with a number for each row; repeated rows get different ones."""
    return materialize(df.withColumn(tag, F.monotonically_increasing_id()), label)


def whole_text(text: Column | str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, nothing else. For texts of ASCII alone that is what ``lower`` does, faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def held_out(doc_id: Column) -> Column:
    """Whether labels of a document are kept out of training: crc32 of its id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def require(df: DataFrame, columns: Iterable[str]) -> None:
    """A clear error for a missing column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")


def salted_groups(rows: DataFrame, keys: list[str], spread: Column, first: Column, *, salts: int = 64) -> tuple[DataFrame, DataFrame]:
    """Aggregate groups in two steps, ready to be joined back without a hot task.

    Returns ``(rows with _salt, groups)``. ``groups`` has one row for each key and each
    salt that occurs under it, with ``_n`` (rows of the key) and ``_first`` (the
    aggregate ``first`` over the key), so a join on ``keys + ['_salt']`` spreads a key with a
    third of all rows over ``salts`` tasks and never multiplies rows.
    """
    rows = rows.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.lit(salts)), F.lit(0)).cast("int"))
    part = rows.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"), first.alias("_first"))
    return rows, part


def finish_groups(part: DataFrame, keys: list[str], merge: Column) -> DataFrame:
    """Second step of :func:`salted_groups`: totals of each key, repeated for its own salts only."""
    total = part.groupBy(*keys).agg(F.sum("_n").alias("_n"), merge.alias("_first"), F.collect_list("_salt").alias("_salts"))
    return total.withColumn("_salt", F.explode("_salts")).drop("_salts")


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``_i``, the place in its group ``_g`` by ``order``, and ``_n``, the group's rows.

    Rows are range-partitioned and sorted; a part knows the places of its own rows, and running sums over the parts (a row for each part and group) give the rest.
    """
    by = [F.col(c).asc_nulls_first() for c in ("_g", *order)]
    ranged = materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33).alias("_part")
    parts = ranged.groupBy("_g", part).agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_rows"))
    group = Window.partitionBy("_g")
    before = F.sum("_rows").over(group.orderBy("_part")) - F.col("_rows")
    parts = parts.select("_g", "_part", (before - F.col("_from")).alias("_shift"), F.sum("_rows").over(group).alias("_n"))
    return ranged.withColumn("_part", part).join(parts, ["_g", "_part"]).withColumn("_i", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Python workers of this session get so many rows at a time at most: whole texts are long, and two workers share an executor's memory.

    Results are lazy and run under the session's settings, so these stay set.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
