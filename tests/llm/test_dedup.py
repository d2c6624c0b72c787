import hashlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from cairn.llm import exact_dedup as ex
from cairn.llm import simhash as sh

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_groups(docs):
    rows = docs.collect()
    norm = [(r.doc_id, (r.text or "").translate(LOWER)) for r in rows]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    want = Counter()
    for t, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda i: (i is not None, i or 0))):
            want[(i, top, len(ids), k == len(ids) - 1, hashlib.sha256(t.encode()).hexdigest())] += 1
    got = Counter(tuple(r) for r in ex.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == want


def test_drop_exact_copies_keeps_columns(docs):
    kept = ex.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({(r.text or "").translate(LOWER) for r in docs.collect()})


def test_chunks_cover_the_text(spark):
    for text in ("", "x" * 9000, "a b " * 3000, "line\nbreaks é " * 500):
        df = spark.createDataFrame([(text,)], "t string").select(F.regexp_extract_all("t", F.lit(ex.chunk_pattern()), F.lit(0)).alias("c"))
        chunks = df.first().c
        assert "".join(chunks) == text and all(len(c) <= ex.MAX_CHUNK + 2 for c in chunks)


def test_colliding_identifiers_are_found(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (2, 1, "c"), (2, 1, "c")], "_a long, _b long, _chunk string")
    assert [(r._a, r._n) for r in ex.colliding(rows).collect()] == [(1, 2)]


def brute_fingerprint(text):
    words = [w for w in "".join(c if c not in " \t\n\v\f\r" else " " for c in (text or "").translate(LOWER)).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(pairs):
    """pairs: (id, fingerprint). The smallest id of each row's component."""
    fps = sorted({f for _, f in pairs})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(b)] = find(a)
    low = {}
    for i, f in pairs:
        r = find(f)
        low[r] = min((x for x in (low.get(r), i) if x is not None), default=None)
    return [(i, f, low[find(f)]) for i, f in pairs]


def brute_kept(pairs):
    """The smallest id of each component of texts."""
    near = lambda a, b: (a ^ b).bit_count() <= 2
    groups = []
    for i, f in pairs:
        met = [g for g in groups if any(near(f, x) for _, x in g)]
        groups = [g for g in groups if g not in met] + [[(i, f)] + [x for g in met for x in g]]
    return Counter(min((i for i, _ in g if i is not None), default=None) for g in groups)


def test_near_components(docs):
    pairs = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    got = Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in sh.near_dedup(docs).collect())
    assert got == Counter(brute_components(pairs))


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    import random

    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = list({c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(8)) for c in centres for _ in range(60)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    want = Counter(brute_components(list(enumerate(fps))))
    rows = spark.createDataFrame(signed, "doc_id long, fp long")
    for most in (64, 3, 1):
        monkeypatch.setattr(sh, "PAIRED_AT_MOST", most)
        got = Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in sh.simhash_components(rows).collect())
        assert got == want, most


def test_components_of_few_and_of_many_links(spark, monkeypatch):
    import random

    rng = random.Random(21)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(80)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {(v, find(v)) for v in root}
    for most in (200_000, 3):
        monkeypatch.setattr(sh, "TASK_LINKS", most)
        assert {tuple(r) for r in sh.components(spark.createDataFrame(links, "a long, b long")).collect()} == want


def test_drop_near_copies(spark, docs):
    kept = sh.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == brute_kept([(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()])
    rows = [(None, f"a{k} b{k} c{k} d{k} e{k}") for k in range(6)] + [(7, f"k{k} l{k} m{k} n{k} o{k}") for k in range(6)]
    assert sh.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).count() == 12


def test_op2_columns(spark):
    sf = "/root/testdata/sf0.001"
    pairs = [(r.doc_id, brute_fingerprint(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sh.op2_simhash(spark, sf)
    assert [(c, t) for c, t in got.dtypes] == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    assert Counter(map(tuple, got.collect())) == Counter((i, f"{f:016x}", c) for i, f, c in brute_components(pairs))


def test_empty_tables(empty):
    assert ex.exact_dedup(empty).count() == 0
    assert sh.near_dedup(empty).count() == 0
    assert ex.drop_exact_copies(empty).count() == 0 and sh.drop_near_copies(empty).count() == 0
