import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import decontaminate as dc
from cairn.llm import shuffle_shards as ss


def brute_search(text, items):
    words, hit, found = dc.words_of(text), set(), set()
    for item, t in items:
        w = dc.words_of(t)
        m = min(13, len(w))
        for a in range(len(w) - m + 1 if m else 0):
            for i in range(len(words) - m + 1):
                if words[i : i + m] == w[a : a + m]:
                    hit |= set(range(i, i + m))
                    found.add(item)
    return len(words), hit, found


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=20), min_size=1, max_size=4), st.lists(st.sampled_from("abcd"), max_size=80))
def test_search(items, doc):
    items = [(k, " ".join(w)) for k, w in enumerate(items)]
    texts = ["-".join(doc), None, "-".join(doc[5:]), "c a"]
    results = list(dc.tables_of(items).search(texts))
    for t, (k, s, f) in zip(texts, results, strict=True):
        want = brute_search(t, items)
        assert (k, {p for a, b in s for p in range(a, b)}, f) == want
    n, spans, found = results[0]
    want = brute_search("-".join(doc), items)
    assert (n, {p for a, b in spans for p in range(a, b)}, found) == want
    assert all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_blocks_of_the_benchmark_agree(spark, docs):
    texts = [r.text for r in docs.select("text").orderBy("doc_id").limit(90).collect() if r.text]
    items = [(k, t[:200]) for k, t in enumerate(texts[::6])] + [(None, texts[1][:150]), (99, None), (98, "  ")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = dc.find_contamination(docs, bench).select("doc_id", "n_words", "spans", "items", "contaminated")
    parts = dc.find_contamination(docs, bench, block_bytes=400).select(*whole.columns)
    key = lambda df: Counter(str(r) for r in df.collect())
    assert key(whole) == key(parts)
    for r in dc.find_contamination(docs, bench).collect()[:40]:
        n, hit, found = brute_search(r.text, [i for i in items if i[1]])
        assert r.n_words == n and {p for s in r.spans for p in range(s.start, s.stop)} == hit
        assert r["items"] == sorted(str(i) for i in found if i is not None)
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= n)
    kept = dc.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == whole.where("not contaminated").count()


def test_empty_benchmark(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.find_contamination(docs, none).where("contaminated or size(spans) > 0").count() == 0
    assert dc.find_contamination(empty, none).count() == 0


def test_matrix_margins():
    rng = random.Random(1)
    for shards in (1, 3, 16):
        blocks = [rng.randint(0, 500) for _ in range(30)]
        sizes = ss.shard_sizes(sum(blocks), shards)
        m = ss.communication_matrix(blocks, sizes, 7)
        assert [sum(r) for r in m] == blocks and [sum(c) for c in zip(*m)] == sizes
        assert all(x >= 0 for r in m for x in r)


def test_hypergeometric_law():
    from math import comb

    rng, n = random.Random(4), 20000
    seen = Counter(ss.hypergeometric(rng, 7, 13, 9) for _ in range(n))
    for k in range(8):
        assert abs(seen[k] / n - comb(7, k) * comb(13, 9 - k) / comb(20, 9)) < 0.015
    assert ss.hypergeometric(rng, 10**10, 10**10, 10**6) // 10**4 in range(45, 56)


def test_shards(docs):
    for rows in (3, 20_000):
        out = ss.shuffle_shards(docs, "doc_id", shards=16, block_rows=rows).collect()
        assert Counter(str(tuple(r)[: len(docs.columns)]) for r in out) == Counter(str(tuple(r)) for r in docs.collect())
        slots = defaultdict(list)
        for r in out:
            slots[r.shard].append(r.slot)
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 16
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_do_not_depend_on_partitions(spark):
    df = spark.range(3000).withColumnRenamed("id", "doc_id")
    one = {tuple(r) for r in ss.shuffle_shards(df.repartition(7), "doc_id", block_rows=100).collect()}
    assert one == {tuple(r) for r in ss.shuffle_shards(df.coalesce(1), "doc_id", block_rows=100).collect()}
    by_shard = Counter((i // 1000, s) for i, s, _ in one)
    assert all(30 < n < 100 for n in by_shard.values())  # 62.5 expected of each third in each shard


def test_few_rows(spark, empty):
    assert ss.shuffle_shards(empty, "doc_id").count() == 0
    assert [(r.shard, r.slot) for r in ss.shuffle_shards(spark.range(1), "id").collect()] == [(0, 0)]


def test_equal_rows_are_spread(spark, monkeypatch):
    """Half of the rows are wholly equal: they are numbered in parts, dealt to all blocks, and none is lost."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(ss, "COPIES", 300)
    df = spark.range(4000).select(F.when(F.col("id") < 2000, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") >= 1000, "x").alias("t"))
    out = ss.shuffle_shards(df.repartition(3), "doc_id", block_rows=100).collect()
    assert Counter((r.doc_id, r.t) for r in out) == Counter(tuple(r) for r in df.collect())
    for equal in ((7, None), (7, "x")):
        by_shard = Counter(r.shard for r in out if (r.doc_id, r.t) == equal)
        assert len(by_shard) == 16 and all(30 < n < 100 for n in by_shard.values())  # 62.5 expected
    rows = df.select(F.struct("doc_id", "t").alias("row"), F.col("doc_id").alias("key"), F.xxhash64("doc_id", "t").alias("rest"))
    copies = ss.numbered_copies(rows).where("key = 7").groupBy("row").agg(F.sort_array(F.collect_list("copy")).alias("c")).collect()
    assert [list(r.c) for r in copies] == [list(range(1000))] * 2
    assert {tuple(r) for r in ss.shuffle_shards(df.repartition(5), "doc_id", block_rows=100).collect()} == set(map(tuple, out))
