import random
from collections import Counter

import pytest

from cairn.llm import repeated_text as rt


def brute(rows, length=rt.LENGTH):
    """rows: (id or None, tie, text) without repeated ones. Removed spans of each."""
    first = {}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, rows[k][1]))
    out = {}
    for k in order:
        data = (rows[k][2] or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in first:
                gone[i : i + length] = b"\1" * length
            else:
                first[s] = i
        out[k] = bytes(b for b, g in zip(data, gone) if not g)
    return out


@pytest.mark.parametrize("partitions", [1, 5])
def test_against_brute_force(spark, docs, partitions):
    docs = docs.repartition(partitions)
    rows = [(r.doc_id, 0, r.text) for r in docs.select("doc_id", "text").distinct().collect()]
    # ids that occur with two texts are ordered by a hash; take it from Spark
    from pyspark.sql import functions as F

    ties = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(0x7FFFFFFF)).alias("h")).collect()}
    rows = [(i, ties[i, t], t) for i, _, t in rows]
    kept = brute(rows)
    want = Counter((rows[k][0], len((rows[k][2] or "").encode()), kept[k]) for k in kept)
    seen = Counter((r.doc_id, r.text) for r in docs.collect())
    for (i, t), n in seen.items():
        if n > 1:
            data = (t or "").encode()
            want[(i, len(data), b"" if len(data) >= rt.LENGTH else data)] += n - 1
    got = Counter((r.doc_id, r.n_bytes, bytes(r.kept)) for r in rt.remove_repeats(docs).collect())
    assert got == want


def test_unique_ids_periods_and_long_texts(spark, monkeypatch):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    base = " ".join(word() for _ in range(400))
    texts = [base, "a" * 700, "ab" * 300 + base[100:900], base[50:149], base[50:150], base[7:500] + "!" + base[300:1200], "xyz " * 500, "b" + "a" * 99, base, None, ""]
    rows = [(i, t) for i, t in enumerate(texts)]
    want = brute([(i, 0, t) for i, t in rows])
    monkeypatch.setattr(rt, "SEGMENT", 1 << 18)
    got = {r.doc_id: r for r in rt.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, _ in rows:
        assert bytes(got[i].kept) == want[i], i
        assert sum(s.stop - s.start for s in got[i].spans) == got[i].n_bytes - len(want[i])


def test_texts_made_to_collide_keep_their_bytes(spark):
    rng = random.Random(11)
    say = lambda: "".join(rng.choice("abcdefghij klmno") for _ in range(200))
    left, right = say(), say()
    rows = [(1, left + "%,',!!!!!!%!!!" + right), (2, left + "!!!!*!%1-&!'%!" + right)]
    want = brute([(i, 0, t) for i, t in rows])
    got = {r.doc_id: r for r in rt.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [bytes(got[i].kept) for i in (1, 2)] == [want[0], want[1]] and len(want[1]) > 0


def test_one_rank_for_everything_changes_nothing(spark, monkeypatch, docs):
    """Where all anchors have one hash, digests of the bytes alone decide."""
    import numpy as np

    rows = [(i, t or "") for i, t in enumerate(sorted({r.text or "" for r in docs.select("text").limit(60).collect()}))]
    class Alike:
        xxh64_intdigest = staticmethod(lambda data, seed=0: 5)

    monkeypatch.setattr(rt, "xxhash", Alike)
    plain = lambda x: x.tolist() if isinstance(x, np.ndarray) else x
    runs = {i: np.concatenate([r for _, r in rt.anchor_runs(t.encode())] or [np.zeros(0, np.int64)]) for i, t in rows}
    for cut in (rt.ranked_runs, rt.ranked_cells, rt.ranked_strings):
        given = [(i, 0, cut(t.encode(), runs[i][runs[i] % 2 == 0], b"salt"), runs[i][runs[i] % 2 == 1]) for i, t in rows if i in runs]
        frames = [tuple(map(plain, r)) for f in rt.gathered(given) for r in f.itertuples(index=False)]
        runs = {r._doc: np.array(r._runs) for r in rt.settled(spark.createDataFrame(frames, rt.RANKED)).collect()}
    want = brute([(i, 0, t) for i, t in rows])
    for k, (i, t) in enumerate(rows):
        odd = runs[i][runs[i] % 2 == 1] if i in runs else np.zeros(0, np.int64)
        spans = rt.spans_of(len(t.encode()), *rt.unpack(odd)[::2])
        assert len(t.encode()) - sum(b - a for a, b in spans) == len(want[k])


def test_random_small_corpora(spark):
    """Boundaries of shared passages at every distance, in many small texts at once."""
    rng = random.Random(12)
    say = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    shared = [say(rng.randint(90, 260)) for _ in range(6)]
    rows = []
    for i in range(150):
        parts = [say(rng.randint(0, 40)) if rng.random() < 0.5 else (s := rng.choice(shared))[rng.randint(0, 30) : len(s) - rng.randint(0, 30)] for _ in range(rng.randint(1, 5))]
        rows.append((i, "".join(parts)))
    want = brute([(i, 0, t) for i, t in rows])
    for n in (1, 7):
        got = {r.doc_id: bytes(r.kept) for r in rt.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect()}
        assert got == want


def test_op8_columns(spark):
    import hashlib

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, 0, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    kept = brute(rows)
    got = rt.op8_repeated_text(spark, sf)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    want = {(i, len(t.encode()), len(t.encode()) - len(kept[k]), hashlib.sha256(kept[k]).hexdigest()) for k, (i, _, t) in enumerate(rows)}
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got.collect()} == want


def test_segments_change_nothing(monkeypatch):
    import numpy as np

    data = (b"the quick brown fox jumps over the lazy dog " * 40)[:1500] + bytes(range(97, 123)) * 20
    starts = list(range(len(data) - 99))
    for segment in (1 << 18, 128):
        monkeypatch.setattr(rt, "SEGMENT", segment)
        rt._powers.cache_clear()
        runs = np.concatenate([r for _, r in rt.anchor_runs(data)])
        assert sorted(p for r in runs.tolist() for p in range(r >> 13, (r >> 13) + (r >> 1 & 63))) == starts
        ranks, _, packed = rt.ranked_cells(data, runs, b"salt")
        cells = packed.tolist()
        assert sorted(p for c in cells for p in range(c >> 13, (c >> 13) + (c >> 1 & 63))) == starts
        shared = {}
        for rank, c in zip(ranks.tolist(), cells):  # all strings of cells of one rank have 88 bytes in common
            for p in range(c >> 13, (c >> 13) + (c >> 1 & 63)):
                found = {data[x : x + rt.CORE] for x in range(p, p + rt.CELL)}
                shared[rank] = shared.get(rank, found) & found
        assert all(shared.values())
        assert sorted((rt.ranked_strings(data, packed, b"salt")[2] >> 13).tolist()) == starts
    rt._powers.cache_clear()


def test_empty(empty):
    assert rt.remove_repeats(empty).count() == 0


def test_texts_of_one_id_with_one_hash_keep_their_bytes(spark):
    """Different texts under null or equal ids whose ordering hash is the same are different texts."""
    from pyspark.sql import functions as F

    said = F.concat(*[F.sha2(F.concat(F.lit(f"{k}:"), F.col("id").cast("string")), 256) for k in range(3)])
    found = spark.range(150_000).select(said.alias("text")).withColumn("h", F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)))
    pairs = [r.texts for r in found.groupBy("h").agg(F.collect_list("text").alias("texts")).where("size(texts) > 1").collect()]
    assert pairs
    for doc_id in (None, 7):
        rows = [(doc_id, t) for pair in pairs for t in pair] * 2
        got = Counter((len(r.kept), len(r.spans)) for r in rt.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
        assert got == {(192, 0): len(rows) // 2, (0, 1): len(rows) // 2}  # of each text once whole, once as a copy
