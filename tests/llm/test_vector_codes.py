"""Codes, errors and codebooks against plain whole-number arithmetic, and the query against its SQL."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm.vector_codes import OP13_SQL, encode_vectors, op13_vector_codes


def plain(rows, parts, entries, rounds, scale=4096):
    """{id: (code, error)} and the codebooks for rows of (id, vector)."""
    kept = [(i, [math.floor(float(np.float32(x)) * scale) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v in sorted(kept)[:entries]] for p in range(parts)]
    squared = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v, book: min((squared(v, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v in kept:
                groups.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, group in groups.items():
                books[p][k] = [sum(c) // len(group) for c in zip(*group, strict=True)]
    found = {i: [nearest(cut(v, p), books[p]) for p in range(parts)] for i, v in kept}
    return {i: (bytes(k for _, k in f), min(sum(d for d, _ in f), 2**63 - 1)) for i, f in found.items()}, books


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


@pytest.mark.parametrize(("parts", "entries", "size"), [(2, 3, 1.0), (4, 16, 0.01), (1, 5, 1.0), (2, 4, 30_000.0), (2, 4, 1e30)])
def test_codes_are_the_plain_ones(spark, parts, entries, size):
    rng = random.Random(parts)
    rows = [(3 * i - 50, [float(np.float32(rng.gauss(0, size))) for _ in range(8)], i % 3 or None) for i in range(120)]
    rows += [(1000, rows[5][1], 1), (1001, rows[5][1], 1), (1002, [0.0] * 8, None)]
    odd = [(2000, None, 1), (2001, [None] + [1.0] * 7, 1), (2002, [float("nan")] + [1.0] * 7, 1), (2003, [float("-inf")] + [1.0] * 7, None)]
    coded, books = encode_vectors(frame(spark, rows + odd).withColumns({"part": F.lit(1), "_tag": F.lit("x")}), parts=parts, entries=entries, rounds=3)
    want, want_books = plain([r[:2] for r in rows], parts, entries, 3)
    assert {r.vec_id: (bytes(r.code), r.error) for r in coded.collect()} == want
    assert books.parts == want_books and {"part", "_tag", "label"} < set(coded.columns)


def test_edges(spark):
    coded, books = encode_vectors(frame(spark, [(1, None, 1)]))
    assert coded.count() == 0 and books is None
    few = [(1, [0.5] * 8, 1), (2, [0.25] * 8, None), (None, [0.5] * 8, None)]
    coded, books = encode_vectors(frame(spark, few))
    assert sorted((r.vec_id or 0, bytes(r.code), r.error) for r in coded.collect()) == [(0, bytes(8), 0), (1, bytes(8), 0), (2, bytes([1] * 8), 0)]
    assert encode_vectors(frame(spark, [(1, [], 1), (2, [], 1)]))[0].agg(F.sum("error")).first()[0] == 0
    for bad in ([(1, [1.0] * 9, 1)], [(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)]):
        with pytest.raises(ValueError, match="same number"):
            encode_vectors(frame(spark, bad))
    with pytest.raises(ValueError, match="Code"):
        encode_vectors(frame(spark, few).withColumn("Code", F.lit(1)))


def test_query_is_its_sql(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    odd = spark.createDataFrame([(9001, None, 1), (9002, [float("nan")] * 64, 2), (9003, [0.1] * 64, None), (9004, [0.1] * 64, None)], "vec_id long, embedding array<float>, label int")
    rows.unionByName(odd).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = op13_vector_codes(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({OP13_SQL})").fetchall())
