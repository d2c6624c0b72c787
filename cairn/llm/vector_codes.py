"""Product codes of vectors in exact integer arithmetic.

Vectors are kept in blocks. A block has a dictionary for each dimension, its distinct integers, and the vectors as dictionary codes. With a
codebook at hand, squared differences of every dictionary value to all entries are tabulated; the distances of a part are gathered from
the tables by code and added. New entries need no vector either: codes are counted for each entry, and counts times dictionary
values are the sums. So each round reads the blocks, and only sums of a task leave it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import finish_groups, materialize, refuse, require, salted_groups

#: Vectors of a block at most.
BLOCK_ROWS = 8192
#: Integers and sums of their squared differences up to here are exact in 64 bits; larger ones are computed as Python integers.
EXACT_INTEGER = 1 << 24
LONG_MAX = 2**63 - 1
BLOCKS = "tags binary, sizes binary, large boolean, dictionary binary, codes binary"


def whole(x: float, scale: int) -> int:
    return math.floor(float(x) * scale)


def block_of(tags: np.ndarray, vectors: np.ndarray, scale: int) -> dict:
    """Row tags, sizes of the dictionaries, their values one after another, and codes by dimension. ``large`` values don't fit in 64 bits and are decimal texts."""
    scaled = np.floor(vectors.astype(np.float64) * scale)
    large = bool(np.abs(scaled).max(initial=0) >= 2**62)
    if not large:
        columns = scaled.T.astype(np.int64)
        parts = [np.unique(c, return_inverse=True) for c in columns]
        values = b"".join(p[0].astype("<i8").tobytes() for p in parts)
    else:
        parts = [np.unique(np.array([whole(x, scale) for x in c], object), return_inverse=True) for c in vectors.T]
        values = b",".join(str(v).encode() for p in parts for v in p[0])
    return {"tags": tags.astype("<i8").tobytes(), "sizes": np.array([len(p[0]) for p in parts], "<i4").tobytes(), "large": large, "dictionary": values, "codes": b"".join(p[1].astype("<u2").tobytes() for p in parts)}


def read_block(row) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Tags, the dictionary of each dimension and the codes (dimension, row)."""
    tags, sizes = np.frombuffer(row.tags, "<i8"), np.frombuffer(row.sizes, "<i4")
    flat = np.array([int(v) for v in bytes(row.dictionary).split(b",")], object) if row.large else np.frombuffer(row.dictionary, "<i8")
    if flat.dtype != object and np.abs(flat).max(initial=0) >= EXACT_INTEGER:
        flat = flat.astype(object)
    return tags, np.split(flat, np.cumsum(sizes)[:-1]), np.frombuffer(row.codes, "<u2").reshape(len(sizes), len(tags))


def assign(dictionaries: list[np.ndarray], codes: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row (ties: the lowest index) and its squared distance, for one part; ``codebook`` is (entry, dimension)."""
    distance = None
    for j, values in enumerate(dictionaries):
        table = (values[:, None] - codebook[None, :, j]) ** 2
        distance = table[codes[j]] if distance is None else distance + table[codes[j]]
    if distance is None:  # a part without dimensions
        distance = np.zeros((codes.shape[1], len(codebook)), np.int64)
    nearest = np.argmin(distance, axis=1)
    return nearest, distance[np.arange(len(nearest)), nearest]


class Codebooks:
    """(part, entry, dimension of the part) as exact integers."""

    def __init__(self, parts: list[list[list[int]]]):
        self.parts = parts
        large = any(abs(x) >= EXACT_INTEGER for p in parts for e in p for x in e)
        self.arrays = [np.array(p, object if large else np.int64).reshape(len(p), len(p[0])) for p in parts]

    def text(self) -> str:
        return ",".join(str(x) for p in self.parts for e in p for x in e)


def kept_vectors(rows: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is known and has finite components alone."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col(vector_col).isNotNull() & finite)


def blocks_of(rows: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """Blocks of (_tag, _vector)."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), BLOCK_ROWS):
                part = b.iloc[at : at + BLOCK_ROWS]
                vectors = np.stack(part["_vector"].to_list()).reshape(len(part), dimensions)
                yield pd.DataFrame([block_of(part["_tag"].to_numpy(np.int64), vectors, scale)])

    return rows.mapInPandas(pack, BLOCKS)


def new_codebooks(blocks: DataFrame, books: Codebooks) -> Codebooks:
    """One round: entries become the floor of the mean of their parts; unused ones stay. A task gives a row for each entry that it used."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = [[[0] * book.shape[1] for _ in book] for book in books.arrays]
        counts = [np.zeros(len(book), np.int64) for book in books.arrays]
        for b in batches:
            for row in b.itertuples():
                _, dictionaries, codes = read_block(row)
                at = 0
                for k, book in enumerate(books.arrays):
                    own, part = dictionaries[at : at + book.shape[1]], codes[at : at + book.shape[1]]
                    nearest, _ = assign(own, part, book)
                    counts[k] += np.bincount(nearest, minlength=len(book))
                    for j, values in enumerate(own):
                        used = np.bincount(nearest * len(values) + part[j], minlength=len(book) * len(values)).reshape(len(book), len(values))
                        for e, s in enumerate((used.astype(object) if values.dtype == object else used) @ values):
                            totals[k][e][j] += int(s)
                    at += book.shape[1]
        found = [(k, e, int(counts[k][e]), [str(s) for s in totals[k][e]]) for k in range(len(counts)) for e in range(len(counts[k])) if counts[k][e]]
        yield pd.DataFrame(found, columns=["part", "entry", "n", "sums"])

    made = blocks.mapInPandas(sums, "part int, entry int, n long, sums array<string>")
    wide = made.select("part", "entry", "n", F.posexplode_outer("sums").alias("j", "s"))
    # A row for each component of the codebooks.
    total = wide.groupBy("part", "entry", "j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    parts = [[list(e) for e in p] for p in books.parts]
    for r in total:
        if r.j is not None:
            parts[r.part][r.entry][r.j] = int(r.s) // r.n
    return Codebooks(parts)


def encode_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, Codebooks | None]:
    """Kept rows with ``code`` (a byte for each part) and ``error`` (squared distances summed over the parts), and the codebooks, None if no row is kept.

    Rows whose vector is null, or holds null or components that aren't finite, are left out. Components become floor(``scale`` * x); codebooks begin with the
    parts of the ``entries`` smallest ids (null ids last, ties by vector; fewer rows make fewer entries). Rounds assign each part to its nearest entry (ties: the lowest) and
    move entries to the floor of the mean. All is exact; an error beyond a long is given as the largest one. Repeated rows are coded alike, vectors without components have zeros.
    All vectors need the same length, a multiple of ``parts``. Other columns stay; ``code`` and ``error`` are taken. An empty table gives an empty result.
    """
    require(vectors, [id_col, vector_col])
    refuse(vectors.columns, ["code", "error"])
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    kept = kept_vectors(vectors, vector_col)
    whole_rows = F.struct(*[F.col(f"`{c}`") for c in vectors.columns]).alias("_row")
    rows = materialize(kept.select(whole_rows, F.col(vector_col).cast("array<double>").alias("_vector"), F.monotonically_increasing_id().alias("_tag")), "vectors")
    least, most = rows.agg(F.min(F.size("_vector")), F.max(F.size("_vector"))).first()
    if least is None:
        return rows.select("_row.*", F.lit(bytearray()).alias("code"), F.lit(0).cast("long").alias("error")), None
    if least != most or most % parts:
        raise ValueError(f"vectors have {least} to {most} components; all need the same number, a multiple of {parts}")
    first = [r["_vector"] for r in rows.orderBy(F.col(f"_row.`{id_col}`").asc_nulls_last(), "_vector").limit(entries).select("_vector").collect()]
    width = most // parts
    books = Codebooks([[[whole(x, scale) for x in v[p * width : (p + 1) * width]] for v in first] for p in range(parts)])
    blocks = materialize(blocks_of(rows.select("_tag", "_vector"), most, scale), "vector-blocks")
    for _ in range(rounds):
        books = new_codebooks(blocks, books)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                tags, dictionaries, codes = read_block(row)
                found = [assign(dictionaries[k * width : (k + 1) * width], codes[k * width : (k + 1) * width], book) for k, book in enumerate(books.arrays)]
                error = sum(d.astype(object) for _, d in found)
                coded = np.stack([nearest for nearest, _ in found], axis=1).astype(np.uint8)
                yield pd.DataFrame({"_tag": tags, "code": [c.tobytes() for c in coded], "error": [min(int(e), LONG_MAX) for e in error]})

    coded = blocks.mapInPandas(code, "_tag long, code binary, error long")
    return rows.select("_tag", "_row").join(coded, "_tag").select("_row.*", "code", "error"), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code and the error of every kept vector, errors summed by label, and the digest of the codebooks; odd rows as in :func:`encode_vectors`."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    coded, books = encode_vectors(vectors)
    code = F.lower(F.hex("code"))
    rows = materialize(coded.select("vec_id", code.alias("code"), "error", F.col("label").alias("_label"), F.col("label").isNull().alias("_none")), "vector-codes")
    # A label may have a third of all rows: sums are made by salt first, and each salt meets its own copy of the total.
    rows, part = salted_groups(rows, ["_label", "_none"], F.col("vec_id"), F.sum(F.col("error").cast("decimal(38,0)")))
    total = finish_groups(part, ["_label", "_none"], F.sum("_first")).select(F.col("_label").alias("_l"), F.col("_none").alias("_o"), F.col("_salt").alias("_s"), F.least("_first", F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long").alias("label_error"))
    same = F.col("_label").eqNullSafe(F.col("_l")) & (F.col("_none") == F.col("_o")) & (F.col("_salt") == F.col("_s"))
    digest = hashlib.sha256(books.text().encode()).hexdigest() if books else None
    return rows.join(total, same).select("vec_id", "code", "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256"))


def _sql() -> str:
    """The same by one CTE for each round: all distances of a part to its codebook, in whole numbers."""
    nearest = "SELECT vec_id, p, arg_min(e, d * 16 + e) AS e, min(d) AS d FROM (SELECT v.vec_id, v.p, b.e, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts v JOIN b{r} b USING (p)) GROUP BY vec_id, p"
    steps = [f"""a{r} AS MATERIALIZED ({nearest.format(r=r)}),
m{r} AS MATERIALIZED (SELECT p, e, list(m ORDER BY j) AS x FROM (SELECT p, e, j, ((sum(c) - (sum(c) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS m
  FROM (SELECT p, e, unnest(x) AS c, unnest(range(8)) AS j FROM a{r} JOIN parts USING (vec_id, p)) GROUP BY p, e, j) GROUP BY p, e),
b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m USING (p, e))""" for r in range(6)]  # fmt: skip
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, v[p * 8 + 1 : p * 8 + 8] AS x FROM kept, range(8) t(p)),
b0 AS MATERIALIZED (SELECT p, e, x FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 16) JOIN parts USING (vec_id)),
{", ".join(steps)},
done AS ({nearest.format(r=6)}),
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM done GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, j)) FROM (SELECT p, e, unnest(x) AS c, unnest(range(8)) AS j FROM b6)) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


#: For the vectors of the given tables, which have 64 components.
OP13_SQL = _sql()
