"""The registered queries on the smallest tables: names, types, digests, against brute force or SQL; and every stage of the pipeline."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cairn.llm import decontaminate, exact_dedup, near_copies, packing, quality, shuffle_shards, token_store, toxicity, url_filter
from cairn.llm.registry import ORACLES
from cairn.llm.tokens import public_tokenizer_path

from .test_near_copies import brute_kept
from .test_search_and_shards import brute_search

#: The classifier needs more labels than the smallest tables have.
SF, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
FULL = Tokenizer.from_file(public_tokenizer_path())


def ids(text, end):
    return np.array([*FULL.encode(text or "", add_special_tokens=False).ids, end], "<u4").tobytes()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def check_pieces(texts, rows, window=packing.WINDOW):
    by_doc, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for i, parts in by_doc.items():
        raw, at = ids(texts[i], packing.END_ID), 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(raw) // 4
            assert r.ids_crc32 == zlib.crc32(raw[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(raw) // 4
    for k, parts in windows.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == window or k == 0


def test_op3(spark, texts):
    got = packing.op3_packing(spark, SF)
    kinds = dict(got.dtypes)
    assert all(kinds[c] == "bigint" for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))
    check_pieces(texts, got.collect())


def test_op4(spark, texts):
    got = token_store.op4_token_store(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    at, want = 0, set()
    for i in sorted(texts):
        raw = ids(texts[i], token_store.END_ID)
        want.add((i, at, len(raw) // 4, zlib.crc32(raw)))
        at += len(raw) // 4
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("name, run", [("op5_decontaminate", decontaminate.op5_decontaminate), ("op9_exact_dedup", exact_dedup.op9_exact_dedup)])
def test_against_sql(spark, name, run):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert Counter(tuple(r) for r in run(spark, SF).select(*columns).collect()) == Counter(want.fetchall())


def test_op6(spark):
    got = url_filter.op6_url_filter(spark, SF)
    assert got.dtypes == [("page_id", "bigint"), ("host", "string"), ("path", "string"), ("rule", "string"), ("verdict", "string")]
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rules = {r.text: r for r in url_filter.RULES}
    for r in got.collect():
        rest = urls[r.page_id].split("://", 1)[1] if "://" in urls[r.page_id] else ""
        rest = rest.split("#")[0].split("?")[0]
        host, path = (rest.split("/", 1)[0].lower(), rest[len(rest.split("/", 1)[0]) :])
        assert (r.host, r.path) == (host, path)
        fit = [x for x in rules.values() if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fit, key=lambda x: len(x.text), default=None)
        assert r.rule == (best.text if best else None) and r.verdict in ((best.verdict,) if best else ("allow", "block"))


def test_url_trees_on_held_out_labels(spark):
    """Labels follow the path's words; a third of the URLs is not learned from."""
    rows = [(k, f"https://h{k % 40}.{'net' if k % 2 else 'info'}/{'shop/offers?id=%d&ref=%d&x=1' % (k, 7 * k) if k % 2 else 'articles/long-read-about-something'}") for k in range(1200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = (url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "info", "/"))
    out = url_filter.filter_urls(pages, rules=rules, learn_from=F.col("page_id") % 3 != 0).where("page_id % 3 = 0").collect()
    assert np.mean([(r.allow_score >= 0.5) == (r.verdict == "allow") for r in out]) > 0.98


def test_suffix_statistics_leave_out_the_own_fold(spark):
    rows = [("a.com", k % 5, float(k % 2)) for k in range(20)] + [("b.com", 0, 1.0)]
    total, by_fold = url_filter.suffix_statistics(spark.createDataFrame(rows, "_suffix string, _fold long, label double"), "suffix")
    assert {tuple(r) for r in total.collect()} == {("a.com", 20, 10.0), ("b.com", 1, 1.0)}
    assert {(r._suffix, r._fold): r._suffix_fold_rows for r in by_fold.collect()} == {**{("a.com", k): 4 for k in range(5)}, ("b.com", 0): 1}


def test_op10(spark, texts):
    got = shuffle_shards.op10_shuffle_shards(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    rows, slots = got.collect(), defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        slots[r.shard].append(r.slot)
    assert len(rows) == len(texts) and set(slots) == set(range(16))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op1_held_out(spark):
    got = toxicity.op1_toxicity(spark, MORE)
    assert got.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MORE}/labels.parquet").collect()}
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{MORE}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    caught, alarms = (np.mean([r.predicted for r in held if labels[r.doc_id] == y]) for y in (1, 0))
    assert caught >= 0.7 and alarms <= 0.05, (caught, alarms)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]
    good = {r.doc_id for r in quality.op7_quality(spark, SF).where("predicted = 1").collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before, after = kept, stage(spark, docs, SF)
        assert after.columns == docs.columns
        # Written and read again, as run() does.
        docs = corpus_pipeline.materialize(after, "test-stage")
        kept = [(r.doc_id, r.text) for r in docs.collect()]
        if k == 0:
            assert {i for i, _ in kept} == good
        elif k == 1:
            last = {}
            for i, t in before:
                key = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
                last[key] = max(last.get(key, i), i)
            assert Counter(i for i, _ in kept) == Counter(last.values())
        elif k == 2:
            assert Counter(i for i, _ in kept) == brute_kept(before)
        else:
            clean = [i for i, t in before if not (hit := brute_search(t, bench)[1]) or 20 * len(hit) < brute_search(t, bench)[0]]
            assert Counter(i for i, _ in kept) == Counter(clean)
    check_pieces(dict(kept), corpus_pipeline.STAGES[4][1](spark, docs, SF).collect())


def test_pipeline_on_odd_documents(spark, docs, tmp_path):
    """Null and repeated ids, null, empty and long texts, columns of any name; run() as a whole."""
    folder = str(tmp_path)
    extra = docs.withColumns({"_row": F.lit(1), "_fp": F.lit(2), "_block": F.lit(3), "_salt": F.lit(4), "items": F.lit("i"), "component_id": F.lit(5), "shard": F.lit(6), "lang": F.lit("en"), "n_chars": F.length("text")})
    extra.unionByName(extra.limit(1).withColumn("text", F.lit("Əli Bakıda yaşayır ƁƆƉ"))).write.parquet(f"{folder}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    stage = spark.read.parquet(f"{folder}/documents.parquet")
    for _, make in corpus_pipeline.STAGES[1:4]:
        after = make(spark, stage, folder)
        assert after.columns == stage.columns and {r.items for r in after.collect()} == {"i"}
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_near_copies_module_is_used():
    assert corpus_pipeline.drop_similar is near_copies.drop_similar
