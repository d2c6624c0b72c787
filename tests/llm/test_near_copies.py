import random
from collections import Counter

import pytest

from cairn.llm import near_copies as nc

SCHEMA = "doc_id long, text string"


def prose(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def changed(rng, words, edits):
    out = list(words)
    for k in rng.sample(range(len(out)), edits):
        out[k] = f"new{rng.randrange(10**6)}"
    return out


def brute_kept(rows):
    """Ids that stay: the least of each component of pairs with five-word Jaccard of 0.8 or more."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for _, t in rows)]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), (2, 0)), (d is None, d or 0))
    return Counter(None if none else d for none, d in best.values())


def planted():
    rng = random.Random(8)
    rows = []
    for k in range(40):
        base = prose(rng, 300)
        rows.append((1000 * k, " ".join(base)))
        # Edits of n words change up to 5n of 296 shingles: similarities from 0.97 to 0.5.
        rows += [(1000 * k + n, " ".join(changed(rng, base, n))) for n in (2, 4, 6, 9, 20)]
    return rows


def test_near_copies_of_similarity_four_fifths_go(spark):
    rows = planted()
    kept = Counter(r.doc_id for r in nc.drop_similar(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect())
    assert kept == brute_kept(rows)


def test_a_large_group_of_near_copies_leaves_one(spark):
    rng = random.Random(9)
    base = prose(rng, 200)
    rows = [(i, " ".join(changed(rng, base, 2))) for i in range(150)] + [(1000 + i, " ".join(prose(rng, 50))) for i in range(20)]
    assert Counter(r.doc_id for r in nc.drop_similar(spark.createDataFrame(rows, SCHEMA)).collect()) == brute_kept(rows)


@pytest.mark.parametrize("rounds", [(5, 12), (5,)])
def test_large_buckets_lose_no_link(spark, monkeypatch, rounds):
    """With one representative for buckets of over 3 rows most links are left to the later rounds, or to the exact last step."""
    monkeypatch.setattr(nc, "PAIRED_AT_MOST", 3)
    monkeypatch.setattr(nc, "REPS", 1)
    monkeypatch.setattr(nc, "BAND_ROWS", rounds)
    rng = random.Random(13)
    rows = []
    for k in range(3):
        base = prose(rng, 300)
        # Copies of a base are up to 8 words away, so less than 0.8 from each other; some are linked to others only.
        first = [changed(rng, base, 7) for _ in range(15)]
        rows += [(1000 * k + i, " ".join(w)) for i, w in enumerate(first)] + [(1000 * k + 100 + i, " ".join(changed(rng, w, 4))) for i, w in enumerate(first)]
    common = prose(rng, 60)
    rows += [(9000 + i, " ".join(common + prose(rng, 40))) for i in range(30)]
    kept = Counter(r.doc_id for r in nc.drop_similar(spark.createDataFrame(rows, SCHEMA)).collect())
    assert kept == brute_kept(rows)


def test_columns_of_any_name_stay(spark):
    rows = [(1, "a b c d e f g", 5, 6, "x"), (2, "a b c d e f g", 7, 8, "y"), (None, None, 1, 2, None), (3, "", None, None, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _row int, _fp int, _sketch string")
    kept = nc.drop_similar(frame)
    assert kept.columns == frame.columns
    assert Counter(map(tuple, kept.collect())) == Counter([rows[0], rows[3]])


def test_rows_of_null_and_repeated_ids_stay(spark):
    rng = random.Random(10)
    rows = [(None, " ".join(prose(rng, 40))) for _ in range(12)] + [(7, " ".join(prose(rng, 40))) for _ in range(12)]
    copied = rows[0][1] + " tail"
    kept = nc.drop_similar(spark.createDataFrame([*rows, (5, copied)], SCHEMA)).collect()
    assert Counter(r.doc_id for r in kept) == Counter({None: 11, 7: 12, 5: 1})
    assert {r.text for r in kept} == {t for _, t in rows[1:]} | {copied}


def test_rare_pairs_hold_all_similar_ones(spark):
    """The candidates of the last step against all pairs, over families of similar texts of many sizes with repeated words."""
    from pyspark.sql import functions as F

    rng = random.Random(21)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(40)}" for _ in range(rng.choice([6, 12, 40, 120, 300]))]
        texts += [" ".join(base)] + [" ".join(changed(rng, base, rng.randint(0, max(1, len(base) // 20))) + prose(rng, rng.choice([0, 0, 1, 3, len(base) // 6]))) for _ in range(14)]
    texts += ["a b", "a b", "a b c", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "_row long, _text string").repartition(3)
    sets = [nc.shingles(t) for t in texts]
    own = spark.createDataFrame([(i, len(s), i) for i, s in enumerate(sets)], "_row long, size int, comp long")
    found = {(r.a, r.b) for r in nc.rare_pairs(own, rows).collect()}
    want = {(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[j] and nc.similar(sets[i], sets[j])}
    assert len(want) > 150 and want <= found and len(found) < len(sets) ** 2 / 4
    # Pairs of one component aren't asked for.
    one = own.withColumn("comp", F.lit(7).cast("long"))
    assert nc.rare_pairs(one, rows).count() == 0


def test_pages_of_one_template_meet_nowhere(spark, monkeypatch):
    """A thousand texts just below the similarity give few pairs, and all stay."""
    rng = random.Random(17)
    base, rows = prose(rng, 300), []
    for i in range(1000):
        at = rng.randrange(266)
        rows.append((i, " ".join([*base[:at], *[f"own{i}x{k}" for k in range(34)], *base[at + 34 :]])))  # similarity 0.77 or less
    pairs = []
    verified = nc.verified
    monkeypatch.setattr(nc, "verified", lambda found, texts: (pairs.append(found.count()), verified(found, texts))[1])
    assert nc.drop_similar(spark.createDataFrame(rows, SCHEMA)).count() == 1000
    assert len(pairs) == 2 and pairs[1] == 0 and pairs[0] < 40_000
