"""Near-duplicates by SimHash, found with pivot distance tables.

Each 64-bit fingerprint gets a row of Hamming distances to reference fingerprints (pivots): the
zero fingerprint, 32 that cover two bits each, and random ones. Two fingerprints within k bits
differ by at most k in every coordinate, and the first pivots make the coordinates that
differ at all few: of four groups of covering coordinates, two groups agree wholly if k is 2. So
candidate pairs share two groups, pairs with a larger coordinate difference are
discarded, and the survivors are verified bit by bit.

A bucket of very many fingerprints is split by the coordinates that it doesn't share yet: of their four quarters at least
two agree wholly as well. Random fingerprints then share a bucket with a chance of 0.375^24, so at any number that fits a cluster buckets
stay small. Only a crowd of near copies can still fill one; its members are linked through the fingerprints one bit away from
them. Two fingerprints are within 2 bits exactly if they share one of those, so no link is lost and their number grows with the members alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, materialize, refuse, require, salted_groups, tagged, text_batches

SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: Two bits for each covering pivot; 32 of them in GROUPS groups.
COVER, GROUPS, RANDOM_PIVOTS = 2, 4, 16
#: A bucket of more fingerprints is split, and one that is still larger is linked through one-bit neighbours.
PAIRED_AT_MOST = 64
#: Fingerprints whose keys a task makes, and links (16 bytes each) that one task joins without an exchange.
TASK_ROWS, TASK_LINKS = 20_000, 200_000


def fingerprint(text: str | None) -> int:
    """SimHash of a whole text: words between ASCII white space, A-Z lower-cased, in shingles of three; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint_udf():
    """Fingerprints of a column of texts, as signed 64-bit numbers."""

    @F.pandas_udf("bigint")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(np.array([fingerprint(t) for t in part], np.uint64).view(np.int64))

    return of


def pivots(random_pivots: int = RANDOM_PIVOTS) -> list[int]:
    """Zero, the covering pivots, then random ones; all signed."""
    rng = np.random.default_rng(2)
    cover = [((1 << COVER) - 1) << s for s in range(0, 64, COVER)]
    return [0, *np.array(cover, np.uint64).view(np.int64).tolist(), *rng.integers(-(2**63), 2**63 - 1, random_pivots).tolist()]


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def part_keys(fp: Column, parts: int) -> list[Column]:
    """Of each of ``parts`` parts of the covering coordinates one number: d(x, pivot) - d(x, 0) takes COVER + 1 values, here digits in that base."""
    zero, *cover = pivots(0)
    each = len(cover) // parts
    keys = []
    for g in range(parts):
        key = F.lit(0).cast("long")
        for p in cover[g * each : (g + 1) * each]:
            key = key * (COVER + 1) + ((distance(fp, F.lit(p)) - distance(fp, F.lit(zero)) + COVER) / 2).cast("long")
        keys.append(key)
    return keys


#: Pairs of groups, by which the first buckets are made; for each of them, pairs of halves of the other groups.
TABLES = list(combinations(range(GROUPS), 2))
SPLITS = [list(combinations([h for g in range(GROUPS) if g not in pair for h in (2 * g, 2 * g + 1)], 2)) for pair in TABLES]


def coordinates(fp: Column) -> Column:
    """The row of the distance table for the random pivots."""
    return F.array(*[distance(fp, F.lit(p)).cast("byte") for p in pivots()[1 + 64 // COVER :]])


def near(a: Column, b: Column, max_bits: int) -> Column:
    """No coordinate differs by more than ``max_bits``."""
    return F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= max_bits), lambda ok: ok)


def shared_buckets(spread: DataFrame) -> DataFrame:
    """Of ``spread`` (with ``key``) the rows whose key occurs again, with ``n``, their number, in a scratch table."""
    # The counts are a table, so Spark may broadcast them, or split a hot key of the other side.
    counts = materialize(spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-counts")
    return materialize(spread.join(counts, "key"), "buckets")


def paired(members: DataFrame) -> DataFrame:
    """Links (a, b) within buckets of at most PAIRED_AT_MOST fingerprints: by coordinates, then bit by bit."""
    small = members.where(F.col("n") <= PAIRED_AT_MOST).select("key", "fp").withColumn("c", coordinates(F.col("fp")))
    other = small.select("key", F.col("fp").alias("fp2"), F.col("c").alias("c2"))
    candidates = small.join(other, "key").where("fp < fp2").where(near(F.col("c"), F.col("c2"), MAX_BITS))
    return candidates.where(distance(F.col("fp"), F.col("fp2")) <= MAX_BITS).select(F.col("fp").alias("a"), F.col("fp2").alias("b"))


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` (a table) exactly as all pairs within MAX_BITS bits do."""
    # They are few bytes, which Spark would leave to one or two tasks.
    fps = fps.repartition(-(-fps.count() // TASK_ROWS) or 1, "fp")
    groups = part_keys(F.col("fp"), GROUPS)
    keys = [F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), groups[g], groups[h]).alias("key")) for t, (g, h) in enumerate(TABLES)]
    members = shared_buckets(fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.t", "k.key"))
    found = paired(members)

    large = members.where(F.col("n") > PAIRED_AT_MOST)
    splits = F.array(*[F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in of]) for of in SPLITS])
    halves = large.select("fp", "t", "key", F.array(*part_keys(F.col("fp"), 2 * GROUPS)).alias("h"))
    finer = F.transform(F.get(splits, F.col("t")), lambda s: F.xxhash64("key", s["x"], s["y"], F.get("h", s["x"]), F.get("h", s["y"])))
    members = shared_buckets(halves.select("fp", F.explode(finer).alias("key")))
    found = found.unionByName(paired(members))

    crowd = members.where(F.col("n") > PAIRED_AT_MOST).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(v) for v in np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64)).view(np.int64).tolist()])
    around = crowd.select("fp", F.explode(F.transform(flips, lambda v: v.bitwiseXOR(F.col("fp")))).alias("z"))
    stars = around.groupBy("z").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = around.join(stars, "z").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return found.unionByName(met).distinct()


def components(links: DataFrame) -> DataFrame:
    """(v, root) for each end of a link; root is the smallest v of its component.

    Alternates large-star and small-star steps until the links no longer change; links stay distributed, each round is a
    table in the shared folder. Minima are tables of their own, so a hub of very many links can be split when it is joined to its own.
    Links that have been counted to be no more than TASK_LINKS are one partition, whose rounds need no exchange.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")

    def sign(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = sign(edges)
    if before[0] == 0:
        return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
    few = before[0] <= TASK_LINKS
    whole = (lambda df: df.coalesce(1)) if few else (lambda df: df)
    held = (lambda df, _: df) if few else materialize
    while True:
        both = whole(edges).select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        low = held(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "links-low")
        large = held(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links-large")
        low = held(large.groupBy("u").agg(F.min("v").alias("m")), "links-low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = materialize(whole(small.where("u <> v")).distinct(), "links")
        after = sign(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("v"), "root").distinct())


def simhash_components(rows: DataFrame, *, id_col: str = "doc_id", fp_col: str = "fp") -> DataFrame:
    """``rows`` (a table: it is read several times) with ``component_id``, the smallest id among all rows reachable over links, and ``root``, the component's smallest fingerprint.

    Equal fingerprints are linked. Null ids are passed over unless a component has no other; repeated
    rows are in one component. An empty table gives an empty result. Columns of the names of the results are refused.
    """
    require(rows, [id_col, fp_col])
    refuse(rows.columns, ["component_id", "root", "_salt"])
    salted, part = salted_groups(rows, [fp_col], F.xxhash64(F.col(id_col)), F.min(id_col))
    part = materialize(part, "fingerprints")
    fps = materialize(part.groupBy(F.col(fp_col).alias("fp")).agg(F.min("_first").alias("low")), "fingerprints")
    roots = materialize(components(fingerprint_links(fps.select("fp"))), "roots")
    of_fp = fps.join(roots, fps["fp"] == roots["v"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    of_fp = materialize(of_fp, "rooted")
    lowest = materialize(of_fp.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    of_fp = of_fp.join(lowest, "root").select(F.col("fp").alias(fp_col), "component_id", "root")
    # One row for each fingerprint and salt: a fingerprint of very many rows is spread over the salts.
    spread = part.select(fp_col, "_salt").join(of_fp, fp_col)
    return salted.join(spread, [fp_col, "_salt"]).select(*rows.columns, "component_id", "root")


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for each row; see :func:`simhash_components`. Null and empty texts have the fingerprint 0; texts may be of any length, and other columns aren't read."""
    require(docs, [id_col, text_col])
    refuse([id_col], ["fp", "component_id"])
    text_batches(docs.sparkSession)
    rows = materialize(docs.select(F.col(id_col).alias("_id"), fingerprint_udf()(text_col).alias("fp")), "simhash")
    return simhash_components(rows, id_col="_id").select(F.col("_id").alias(id_col), "fp", "component_id")


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id (nulls last; of repeated ids and rows any one). Every column stays as it is, whatever its name.

    Components are of texts, so rows of null or repeated ids are rows like any other. Null and empty texts are one component. An
    empty table gives an empty result. The pipeline's rule for near copies is another one: :func:`.near_copies.drop_similar`.
    """
    require(docs, [id_col, text_col])
    text_batches(docs.sparkSession)
    row, fp = free_name(docs, "_row"), free_name(docs, "_fp")
    numbered = tagged(docs.withColumn(fp, fingerprint_udf()(text_col)), "near-input", row)
    linked = simhash_components(numbered.select(F.col(id_col).alias("id"), F.col(fp).alias("fp"), F.col(row).alias("row")), id_col="id")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    # Partial minima are taken before the exchange, so a component of very many rows is no hot key.
    kept = linked.groupBy("root").agg(first.alias("f")).select(F.col("f.row").alias(row))
    return numbered.join(kept, row, "left_semi").drop(row, fp)


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; null, empty, long and repeated rows as in :func:`near_dedup`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_dedup(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
