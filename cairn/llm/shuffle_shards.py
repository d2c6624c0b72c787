"""Uniform sharding by a hypergeometric communication matrix, in DataFrame functions only.

Rows are dealt into blocks by a hash of their key. For each block the exact number of rows that
goes to each shard is drawn from the multivariate hypergeometric law, so that every shard
gets exactly its size. Rows are permuted within their block, cut by those counts, exchanged,
and permuted again within their shard: the outcome is a uniform shuffle.

The matrix has MAX_BLOCKS x shards numbers at most, at any input size; it alone is drawn on the driver.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize, refuse, require, whole_text

#: Copies of a wholly repeated row that one task makes.
COPIES = 10_000
#: Rows of a block aimed at, and the most blocks; beyond that blocks grow and sort on disk.
BLOCK_ROWS, MAX_BLOCKS = 20_000, 4096


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """One draw: how many of ``drawn`` items are good. Inverse of the distribution function, from the mode outwards."""
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    log_choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    p_up = p_down = math.exp(log_choose(good, mode) + log_choose(bad, drawn - mode) - log_choose(good + bad, drawn))
    up = down = mode
    left = rng.random() - p_up
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
        if p_up < 1e-300 and p_down < 1e-300:
            break
    return mode


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def communication_matrix(blocks: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """How many rows each block sends to each shard; row sums are ``blocks``, column sums ``sizes``."""
    rng, left, matrix = random.Random(seed), list(sizes), []
    for n in blocks:
        row, rest = [], sum(left)
        for s, room in enumerate(left):
            rest -= room
            row.append(hypergeometric(rng, room, rest, n))
            n -= row[-1]
            left[s] -= row[-1]
        matrix.append(row)
    return matrix


def numbered_copies(rows: DataFrame) -> DataFrame:
    """``rows`` (row, key, rest) with ``copy``: 0, 1, ... among wholly equal rows, 0 for all others.

    Equal rows are interchangeable, so they are counted, with partial counts, and as many are made anew from one of them, in parts; no task numbers a
    repeated row's copies alone. Rows of one key and hash are told apart by SHA-256 of their values.
    """
    again = materialize(rows.groupBy("key", "rest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("k"), F.col("rest").alias("r")), "shard-repeats")
    if again.isEmpty():
        return rows.withColumn("copy", F.lit(0).cast("long"))
    same = F.col("key").eqNullSafe(F.col("k")) & (F.col("rest") == F.col("r"))
    once = rows.join(again, same, "left_anti").withColumn("copy", F.lit(0).cast("long"))
    more = rows.join(again, same, "left_semi")
    groups = more.groupBy("key", "rest", F.sha2(F.to_json("row"), 256).alias("digest")).agg(F.first("row").alias("row"), F.count(F.lit(1)).alias("n"))
    parts = groups.select("row", "key", "rest", "digest", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))).alias("part"))
    spread = parts.repartition("digest", "part")
    made = spread.select("row", "key", "rest", F.explode(F.sequence(F.col("part") * COPIES, F.least(F.col("n"), (F.col("part") + 1) * COPIES) - 1)).alias("copy"))
    return once.unionByName(made)


def shuffle_shards(df: DataFrame, key: str, *, shards: int = 16, seed: int = 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (0, 1, ... within the shard without a gap).

    Shard sizes are at most one apart. The outcome is a function of the rows and the seed: it
    doesn't depend on files or partitions. Any column may be null; rows with a repeated key are
    ordered by their other columns, and rows that are wholly the same are interchangeable, but spread like any others; equal keys need not
    meet in a shard. Values may be of any length. Every column stays as it is, whatever its name, but columns
    of ``df`` named shard or slot are refused. An empty table gives an empty result.
    """
    require(df, [key])
    refuse(df.columns, ["shard", "slot"])
    spark, names = df.sparkSession, [F.col(f"`{c}`") for c in df.columns]
    total = df.count()
    n_blocks = max(1, min(MAX_BLOCKS, math.ceil(total / block_rows)))
    # The row is one value on the way, so its columns can't meet those made here.
    rows = df.select(F.struct(*names).alias("row"), F.col(f"`{key}`").alias("key"), F.xxhash64(*names).alias("rest"))
    draw = lambda what: F.xxhash64(F.lit(f"{seed}-{what}"), F.col("key"), F.col("rest"), F.col("copy"))
    dealt = numbered_copies(rows).withColumn("block", F.pmod(draw("block"), F.lit(n_blocks)).cast("int"))
    counts = {r["block"]: r["n"] for r in dealt.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    matrix = communication_matrix([counts.get(b, 0) for b in range(n_blocks)], shard_sizes(total, shards), seed)
    ends = [[sum(row[: s + 1]) for s in range(shards)] for row in matrix]
    cuts = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(ends)), "array<array<bigint>>")).alias("block", "ends"))

    local = Window.partitionBy("block").orderBy("order", F.col("key").asc_nulls_first())
    sent = (
        dealt.withColumn("order", draw("first"))
        .withColumn("place", F.row_number().over(local) - 1)
        .join(F.broadcast(cuts), "block")  # n_blocks rows, MAX_BLOCKS at most
        .withColumn("shard", F.size(F.filter("ends", lambda end: end <= F.col("place"))).cast("int"))
        .select("row", "key", "rest", "copy", "shard")
    )
    n_bins = max(1, math.ceil(total / shards / block_rows))
    sent = materialize(sent.withColumn("draw", draw("second")).withColumn("bin", F.pmod(F.col("draw"), F.lit(n_bins)).cast("int")), "shards")
    bins = sent.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inner = Window.partitionBy("shard", "bin").orderBy("draw", F.col("key").asc_nulls_first())
    return (
        sent.withColumn("inner", F.row_number().over(inner) - 1)
        .join(bins, ["shard", "bin"])
        .select("row.*", "shard", (F.col("before") + F.col("inner")).cast("long").alias("slot"))
    )


def op10_shuffle_shards(spark, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, by law ``rows``; null (size 1), empty, long and repeated rows as in :func:`shuffle_shards`."""
    text = F.col("text")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        (F.octet_length(whole_text(text)).cast("long") + 1).alias("size"),
        F.crc32(whole_text(text).cast("binary")).alias("text_crc32"),
    )
    out = shuffle_shards(rows, "doc_id")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
