"""Near copies among documents: shingle Jaccard of 0.8 or more, candidates by MinHash bands and SimHash components.

A text is the set of its five-word shingles. Rows that share a band of MinHash values, or a component of op2's
SimHash pivot tables, are candidates; a pair of Jaccard 0.8 shares one of the 20 bands of 5 values with
probability 0.9996. Each candidate pair is verified on the shingles themselves, so nothing is linked by a hash alone.

A bucket of at most PAIRED_AT_MOST rows is paired wholly. The rows of a larger one meet REPS of them, such as are in the most large buckets and
so the likest to all others. Mostly that makes the bucket one component, and then it has nothing more to say. What is still open is settled exactly, by rare shingles:
among the rows of open buckets shingles are ordered by how many rows have them, the rarest first. Two texts of Jaccard 0.8 share one of the first ninth of the smaller one's
shingles, and the first fifth of the larger one's; else too few are left to share. So pages of one template whose own words make a ninth of them meet nowhere, however many they are.

Components are of rows, not of ids, so null and repeated ids are no different from others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import free_name, materialize, require, tagged, text_batches
from .simhash import components, fingerprint_links, fingerprint_udf

SHINGLE, SIMILAR, SEED = 5, 0.8, 43
#: Values of a band, and the probability with which a pair of similarity SIMILAR shares one.
BAND_ROWS, SHARED = (5,), 0.9996
PAIRED_AT_MOST, REPS, SALTS = 32, 4, 64
#: Values of hash functions that are computed at once.
CHUNK = 1 << 19


def band_count(rows: int) -> int:
    """Bands of so many values that SHARED takes."""
    return math.ceil(math.log(1 - SHARED) / math.log(1 - SIMILAR**rows))


def words(text: str | None) -> list[bytes]:
    """As in op2: words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None) -> set[bytes]:
    w = words(text)
    if not w:
        return set()
    return {b" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))}


def similar(a: set[bytes], b: set[bytes]) -> bool:
    """Jaccard of SIMILAR or more; two texts without words are equal."""
    both = len(a & b)
    return both >= SIMILAR * (len(a) + len(b) - both)


def multipliers(round_no: int = 0) -> tuple[np.ndarray, np.ndarray]:
    rows = BAND_ROWS[round_no]
    rng = np.random.default_rng((SEED, round_no))
    draw = rng.integers(0, 2**63, (2, band_count(rows) * rows), dtype=np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def bands(of: set[bytes], times: np.ndarray, plus: np.ndarray, rows: int = BAND_ROWS[0]) -> np.ndarray:
    """One number for each band of ``rows`` MinHash values, signed."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in of), np.uint64, len(of))
    low = np.full(len(times), np.iinfo(np.uint64).max, np.uint64)
    step = max(1, CHUNK // len(times))
    for at in range(0, len(hashes), step):
        part = hashes[at : at + step, None] * times + plus
        part = (part ^ (part >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        low = np.minimum(low, part.min(0))
    values = low.astype("<u8").reshape(-1, rows)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(values)], np.uint64).view(np.int64)


def sketch_udf(round_no: int = 0):
    """(bands, number of distinct shingles) of a column of texts."""

    @F.pandas_udf("bands array<bigint>, size bigint")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        times, plus = multipliers(round_no)
        for part in parts:
            sets = map(shingles, part)
            rows = [(bands(s, times, plus, BAND_ROWS[round_no]), len(s)) for s in sets]
            yield pd.DataFrame({"bands": [r[0] for r in rows], "size": [r[1] for r in rows]})

    return of


def similar_udf():
    @F.pandas_udf("boolean")
    def of(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in parts:
            known: dict[str | None, set[bytes]] = {}
            out = []
            for a, b in zip(left, right, strict=True):
                if a not in known:
                    known = {a: shingles(a)}
                out.append(similar(known[a], shingles(b)))
            yield pd.Series(out, dtype=bool)

    return of


def buckets(rows: DataFrame) -> DataFrame:
    """(key, _row, size): rows by band, and by SimHash component."""
    fps = materialize(rows.select(F.col("_fp").alias("fp")).distinct(), "near-fingerprints")
    roots = materialize(components(fingerprint_links(fps)), "near-roots")
    root = F.xxhash64(F.lit(-1), F.coalesce("root", "_fp"))
    by_root = rows.join(roots, rows["_fp"] == roots["v"], "left").select(root.alias("key"), "_row", F.col("size").cast("int"))
    return rows.select(F.explode("bands").alias("key"), "_row", F.col("size").cast("int")).unionByName(by_root)


def fits() -> Column:
    """Whether two sizes allow the similarity."""
    return F.least("size", "size2") >= SIMILAR * F.greatest("size", "size2")


def candidates(members: DataFrame, crowd: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of rows of two components that share a bucket: all of a small one, and those with the REPS of a large one (``crowd``)."""
    small = members.where(F.col("n") <= PAIRED_AT_MOST).select("key", "_row", "size", "comp")
    other = small.select("key", F.col("_row").alias("row2"), F.col("size").alias("size2"), F.col("comp").alias("comp2"))
    pairs = small.join(other, "key").where("_row < row2 and comp <> comp2").where(fits()).select(F.col("_row").alias("a"), F.col("row2").alias("b"))
    often = F.count(F.lit(1)).over(Window.partitionBy("_row"))  # a row is in as many buckets as it has bands at most
    ranked = crowd.select("key", F.struct((-often).alias("o"), F.xxhash64("_row").alias("h"), F.col("_row").alias("row"), "size", "comp").alias("r"))
    # Partial minima leave no hot key.
    reps = materialize(ranked.groupBy("key").agg(*first_of("r", REPS)).select("key", F.array_distinct(F.array_compact(F.array(*[f"r{k}" for k in range(REPS)]))).alias("reps")), "near-reps")
    # Buckets of a row mostly have the same representatives; it meets each of them once.
    met = crowd.join(reps, "key").groupBy("_row").agg(F.first("size").alias("size"), F.first("comp").alias("comp"), F.array_distinct(F.flatten(F.collect_list("reps"))).alias("reps"))
    large = met.select("_row", "size", "comp", F.explode("reps").alias("rep")).where("_row <> rep.row and comp <> rep.comp").withColumn("size2", F.col("rep.size")).where(fits())
    return pairs.unionByName(large.select(F.least("_row", "rep.row").alias("a"), F.greatest("_row", "rep.row").alias("b"))).distinct()


def first_of(column: str, n: int) -> list[Column]:
    """The least of ``column`` in all rows, and in ``n`` - 1 halves of them that a hash draws."""
    return [F.min(F.when(F.lit(k == 0) | (F.pmod(F.xxhash64(F.lit(k), f"{column}.row"), F.lit(2)) == 0), F.col(column))).alias(f"r{k}") for k in range(n)]


def similar_roots(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(v, root) of each row (_row, _fp, bands, size) that is in a component with others, by links between similar texts (_row, _text)."""
    spread = buckets(rows).withColumn("comp", F.col("_row"))
    counts = materialize(spread.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("n")).where("n > 1"), "near-counts")
    members = materialize(spread.join(counts, "key"), "near-buckets")
    crowd = members.where(F.col("n") > PAIRED_AT_MOST).drop("n")
    links = materialize(verified(materialize(candidates(members, crowd), "near-pairs"), texts), "near-links")
    roots = materialize(components(links), "near-roots")
    if crowd.isEmpty():
        return roots
    own = open_rows(crowd, roots)
    if own.isEmpty():
        return roots
    rest = materialize(verified(materialize(rare_pairs(own, texts), "near-pairs"), texts), "near-links")
    return materialize(components(links.unionByName(rest)), "near-roots")


def open_rows(crowd: DataFrame, roots: DataFrame) -> DataFrame:
    """(_row, size, comp): rows of large buckets that aren't one component yet, with their components."""
    with_comp = crowd.drop("comp").join(roots.withColumnRenamed("v", "_row"), "_row", "left").withColumn("comp", F.coalesce("root", "_row")).drop("root")
    with_comp = materialize(with_comp, "near-open")
    unlike = materialize(with_comp.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key"), "near-open")
    return materialize(with_comp.join(unlike, "key").groupBy("_row").agg(F.first("size").alias("size"), F.first("comp").alias("comp")), "near-open")


def hashes_udf():
    """Sorted hashes of a text's shingles."""

    @F.pandas_udf("array<bigint>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles(t)), np.uint64)).view(np.int64) for t in part])

    return of


def needed(size: Column, other: Column) -> Column:
    """Shingles that texts of two sizes share if they are similar, at least."""
    return F.ceil(F.lit(SIMILAR / (1 + SIMILAR)) * (size + other) - 1e-9)


def rare_pairs(own: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows (_row, size, comp) of two components that hold all similar ones: those that share one of the first shingles, rare ones before common ones.

    A shingle that one row has joins nothing, nor does one whose rows are one component.
    """
    hashed = materialize(texts.join(own, "_row").select("_row", "comp", hashes_udf()("_text").alias("h")).withColumn("size", F.size("h")), "near-hashes")
    each = hashed.select("_row", "comp", F.explode("h").alias("h"))
    counts = each.groupBy("h").agg(F.count(F.lit(1)).cast("int").alias("n"), (F.min("comp") != F.max("comp")).alias("mixed")).where("n > 1")
    ordered = each.join(materialize(counts, "near-shingles"), "h").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("n", "h", "mixed"))).alias("shared"))
    first = F.col("size") - F.size("shared")  # a row's own shingles come first
    placed = hashed.select("_row", "comp", "size").join(ordered, "_row").select("_row", "comp", "size", first.alias("first"), F.posexplode("shared").alias("k", "s"))
    placed = placed.select(F.col("s.h").alias("h"), "_row", "comp", "size", (F.col("first") + F.col("k")).alias("at"), F.col("s.mixed").alias("mixed"))
    placed = placed.where("mixed").where(F.col("at") <= F.col("size") - F.ceil(SIMILAR * F.col("size") - 1e-9)).drop("mixed")
    placed = materialize(placed, "near-first")
    small = placed.where(F.col("at") <= F.col("size") - needed(F.col("size"), F.col("size")))
    large = placed.select("h", *[F.col(c).alias(f"{c}2") for c in ("_row", "comp", "size", "at")])
    left = F.least(F.col("size") - F.col("at"), F.col("size2") - F.col("at2"))  # shared, if this is the first that they share
    met = small.join(large, "h").where("comp <> comp2").where((F.col("size") < F.col("size2")) | ((F.col("size") == F.col("size2")) & (F.col("_row") < F.col("_row2"))))
    met = met.where(fits()).where(left >= needed(F.col("size"), F.col("size2")))
    return met.select(F.least("_row", "_row2").alias("a"), F.greatest("_row", "_row2").alias("b")).distinct()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``pairs`` (a table) whose texts (_row, _text) are similar."""
    # A small table of rows is broadcast, so texts in no pair aren't moved.
    ends = materialize(pairs.select(F.explode(F.array("a", "b")).alias("_row")).distinct(), "near-ends")
    texts = materialize(texts.join(ends, "_row", "left_semi"), "near-texts")
    # A row in very many pairs is spread over the salts.
    pairs = pairs.withColumns({"_sa": F.pmod(F.xxhash64("b"), F.lit(SALTS)), "_sb": F.pmod(F.xxhash64("a"), F.lit(SALTS))})

    def side(row: str, salt: str) -> DataFrame:
        ends = pairs.select(F.col(row).alias("_row"), salt).distinct()
        return texts.join(ends, "_row").select(F.col("_row").alias(row), salt, F.col("_text").alias(f"_{row}"))

    both = pairs.join(side("a", "_sa"), ["a", "_sa"]).join(side("b", "_sb"), ["b", "_sb"])
    return both.where(similar_udf()("_a", "_b")).select("a", "b")


def drop_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of similar rows: that with the smallest id (nulls last; of repeated ids and rows any one).

    Every column stays as it is, whatever its name. Rows with null or repeated ids are rows like any other. Null and empty texts have no
    shingles and are similar to each other; a text of fewer words than a shingle is one. Texts may be of any length. An empty table gives an empty result.
    """
    require(docs, [id_col, text_col])
    text_batches(docs.sparkSession)
    row, fp, sketch = free_name(docs, "_row"), free_name(docs, "_fp"), free_name(docs, "_sketch")
    numbered = tagged(docs.withColumns({fp: fingerprint_udf()(text_col), sketch: sketch_udf()(text_col)}), "near-input", row)
    rows = numbered.select(F.col(row).alias("_row"), F.col(fp).alias("_fp"), F.col(f"{sketch}.bands").alias("bands"), F.col(f"{sketch}.size").alias("size"))
    roots = similar_roots(rows, numbered.select(F.col(row).alias("_row"), F.col(text_col).alias("_text")))
    of = numbered.select(F.col(row).alias("_row"), F.col(id_col).alias("_id")).join(roots.withColumnRenamed("v", "_row"), "_row")
    of = materialize(of, "near-roots")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    kept = of.groupBy("root").agg(first.alias("f")).select(F.col("f.row").alias("_row"))
    dropped = materialize(of.join(kept, "_row", "left_anti").select(F.col("_row").alias(row)), "near-dropped")
    return numbered.join(dropped, row, "left_anti").drop(row, fp, sketch)
