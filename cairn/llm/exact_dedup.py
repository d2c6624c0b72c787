"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its content says so, each chunk gets an identifier that is verified to
stand for one chunk text alone, and documents are equal when their ordered identifier lists
are. Chunk texts move once, after copies within a task have been merged; all later steps move
identifier lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import finish_groups, free_name, lower_ascii, materialize, refuse, require, salted_groups, tagged, whole_text

#: A chunk ends after a vowel and a blank, no earlier than MIN_CHUNK and no later than MAX_CHUNK characters.
MIN_CHUNK, MAX_CHUNK = 512, 4095


def chunk_pattern(smallest: int = MIN_CHUNK, largest: int = MAX_CHUNK) -> str:
    return rf"(?s).{{{smallest},{largest}}}?[aeiou][ \n]|.{{1,{largest}}}"


def chunk_ids(chunks: Column, seed: int) -> Column:
    """128 bits for each chunk, as one flat list: the first halves, then the second halves."""
    return F.concat(
        F.transform(chunks, lambda c: F.xxhash64(F.lit(seed), c)),
        F.transform(chunks, lambda c: F.xxhash64(F.lit(seed + 1), c)),
    )


def colliding(chunks: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one chunk text (none, as a rule)."""
    distinct = chunks.groupBy("_a", "_b", "_chunk").agg(F.lit(1).alias("_one"))
    return distinct.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")


def recipes(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` (the columns ``keep``) with ``_recipe``, ``_tag`` and ``text_sha256``, in a scratch table.

    The identifiers are verified: all chunk texts are grouped by identifier and text, and where
    one identifier has two texts, every identifier is drawn anew with another seed.
    """
    norm = lower_ascii(whole_text(text_col))
    keep = docs.columns if keep is None else keep
    base = docs.select(
        *[F.col(c) for c in keep],
        F.sha2(norm, 256).alias("_sha"),
        F.regexp_extract_all(norm, F.lit(pattern or chunk_pattern()), F.lit(0)).alias("_chunks"),
    ).withColumn("_tag", F.monotonically_increasing_id())
    base = materialize(base, "recipes")
    seed = 0
    while True:
        chunks = base.select(F.explode("_chunks").alias("_chunk")).select(
            "_chunk", F.xxhash64(F.lit(seed), "_chunk").alias("_a"), F.xxhash64(F.lit(seed + 1), "_chunk").alias("_b")
        )
        if colliding(chunks).isEmpty():
            return base.withColumn("_recipe", chunk_ids(F.col("_chunks"), seed)).drop("_chunks")
        seed += 2


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row for each input row: the columns ``keep`` (``id_col`` by default) and ``_tag``,
    ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they are after lower-casing A-Z. The row with the largest id stays.
    Null text counts as empty; empty texts are equal to each other. Null ids are smaller than all
    others. Of repeated rows with the largest id exactly one stays. Texts may be of any length. An empty table gives an empty result.
    Columns of ``keep`` with the names of the results, or of those used on the way, are refused.
    """
    require(docs, [id_col, text_col])
    keep = [id_col] if keep is None else keep
    refuse(keep, ["keep_id", "group_size", "kept", "text_sha256", "_tag", "_id", "_sha", "_chunks", "_recipe", "_salt", "_n", "_first", "_last"])
    rows = recipes(docs, text_col=text_col, keep=keep)
    rows = rows.withColumn("_id", F.col(id_col))
    last = F.max(F.struct(F.col("_id").isNotNull().alias("has"), F.col("_id").alias("id"), F.col("_tag").alias("tag")))
    narrow, part = salted_groups(rows, ["_recipe"], F.col("_tag"), last)
    groups = finish_groups(part, ["_recipe"], F.max("_first")).select("_recipe", "_salt", F.col("_n").alias("group_size"), F.col("_first").alias("_last"))
    return narrow.join(groups, ["_recipe", "_salt"]).select(
        *keep,
        "_tag",
        F.col("_last.id").alias("keep_id"),
        "group_size",
        (F.col("_tag") == F.col("_last.tag")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without copies; every column stays as it is, whatever its name. The rule, and that for nulls, empty texts and repeated rows, is that of :func:`exact_dedup`."""
    require(docs, [id_col, text_col])
    row = free_name(docs, "_row")
    numbered = tagged(docs, "exact-input", row)
    texts = numbered.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(row).alias("row"))
    kept = exact_dedup(texts, id_col="id", text_col="text", keep=["id", "row"]).where("kept").select(F.col("row").alias(row))
    return numbered.join(kept, row, "left_semi").drop(row)


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Group and fate of every document; null, empty, long and repeated rows as in :func:`exact_dedup`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP9_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM d
"""
