import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairn.llm import packing as pk
from cairn.llm import token_store as ts
from cairn.llm.tokens import WordEncoder, encode_in_parts, public_tokenizer_path

PATH = public_tokenizer_path()
FULL, OWN = Tokenizer.from_file(PATH), WordEncoder(PATH)


def reference(text, end):
    return [*FULL.encode(text or "", add_special_tokens=False).ids, end]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(), st.text(alphabet="abzÄéßſǅ ıİ'sdrevl019²½.,!%$\t\n\r\x0b\xa0\xad<|>"), st.sampled_from(["we'll don't", "<|endoftext|>", "A<|startoftext|>b"]))))
def test_ids_are_those_of_the_library(texts):
    got = [np.frombuffer(b, "<u4").tolist() for b in OWN.encode(texts)]
    assert got == [FULL.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_every_character_below_u0250_and_many_above():
    rng = np.random.default_rng(1)
    points = [*range(1, 0x250), *(int(x) for x in rng.integers(0x250, 0x30000, 3000) if not 0xD800 <= x < 0xE000)]
    texts = [form for c in map(chr, points) for form in (c, f"a{c}b {c}'{c}", f"{c}{c.lower()}x")] + ["Əli Bakıda yaşayır", "ƁƆƉ İstanbul"]
    got = [np.frombuffer(b, "<u4").tolist() for b in OWN.encode(texts)]
    assert got == [FULL.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_file_with_another_pattern_goes_to_the_library(tmp_path):
    import json

    made = json.load(open(PATH, encoding="utf-8"))
    made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = "[\\p{L}]+|[\\p{N}]+"
    other = str(tmp_path / "other.json")
    json.dump(made, open(other, "w", encoding="utf-8"))
    texts = ["we'll see 123 times, don't", "Ünder 42", None, ""]
    for path in (other, public_tokenizer_path("byte_bpe_50k.json")):
        plain = Tokenizer.from_file(path)
        got = [np.frombuffer(b, "<u4").tolist() for b in WordEncoder(path).encode(texts)]
        assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert WordEncoder(PATH).known and not WordEncoder(other).known


def test_cache_bound(monkeypatch):
    import cairn.llm.tokens as tk

    monkeypatch.setattr(tk, "CACHE_WORDS", 3)
    texts = ["one two three four", "five one", "two six seven eight nine"]
    got = [np.frombuffer(b, "<u4").tolist() for b in encode_in_parts(PATH, texts, 1)]
    assert got == [FULL.encode(t, add_special_tokens=False).ids for t in texts]


def test_many_words_are_learned_once(monkeypatch):
    """A worker that meets 200,000 words again and again asks the library for each of them once, and never for white space."""
    own, learned = WordEncoder(PATH), []
    learn = own._learn
    monkeypatch.setattr(own, "_learn", lambda fresh: (learned.extend(fresh), learn(fresh)))
    letters = "abcdefghij"
    words = ["".join(letters[int(d)] for d in str(n)) + "qz" for n in range(200_000)]
    texts = [" \n ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
    for _ in range(2):
        got = [own.encode(texts[i : i + 20]) for i in range(0, len(texts), 20)]
    assert sorted(learned) == sorted(words)
    assert np.frombuffer(got[3][7], "<u4").tolist() == FULL.encode(texts[67], add_special_tokens=False).ids
    assert own.encode([" ", "\n\t", "a "])[:2] == [b"", b""] and own.encode(["  "]) == [b""]


def check_packing(rows, packed, window=pk.WINDOW):
    docs = defaultdict(list)
    for r in packed:
        docs[r.doc_id, r.source].append(r)
    want = defaultdict(list)
    for i, t, s in rows:
        want[i, s].append(np.array(reference(t, pk.END_ID), "<u4").tobytes())
    for key, texts in want.items():
        assert sum(r.length for r in docs[key]) * 4 == sum(map(len, texts))
        if len(texts) == 1:
            parts = sorted(docs[key], key=lambda r: r.start)
            assert b"".join(bytes(r.ids) for r in parts) == texts[0]
            assert [r.start for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
            assert {r.doc_tokens for r in parts} == {len(texts[0]) // 4}
    windows = defaultdict(list)
    for r in packed:
        windows[r.sequence_id].append((r.offset, r.length))
    total = sum(r.length for r in packed)
    assert sorted(windows) == list(range(-(-total // window)))
    for k, parts in windows.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at and n > 0
            at += n
        assert at == window or (k == 0 and at == total % window)


def test_packing(docs, monkeypatch):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    for window, bucket in ((4096, 4_000_000), (256, 500)):
        monkeypatch.setattr(pk, "BUCKET_TOKENS", bucket)
        check_packing(rows, pk.pack(docs, window=window).collect(), window)


def test_packing_with_a_target_and_a_shared_queue(docs, monkeypatch):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    packed = pk.pack(docs, window=128, target={"s0": 2.0, "s1": 1.0, "s2": 1.0}).collect()
    check_packing(rows, packed, 128)
    first = [r for r in packed if r.sequence_id == 3]
    assert abs(sum(r.length for r in first if r.source == "s0") - 64) <= 3
    monkeypatch.setattr(pk, "MAX_QUEUES", 2)
    check_packing(rows, pk.pack(docs, window=128).collect(), 128)


def test_a_target_on_small_sources_beyond_the_queues(spark, monkeypatch):
    monkeypatch.setattr(pk, "MAX_QUEUES", 3)
    text = "stone river cloud lamp " * 30
    sizes = {"big0": 40, "big1": 30, "mid0": 20, "mid1": 20, "small": 10, "least": 10}
    rows = [(100 * k + i, text, s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [(900 + i, text, None) for i in range(10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    packed = pk.pack(frame, window=128, target={"small": 2.0, "least": 1.0, None: 1.0}).collect()
    check_packing(rows, packed, 128)
    for window in (1, 2, 3, 4):
        parts = defaultdict(int)
        for r in packed:
            if r.sequence_id == window:
                parts[r.source] += r.length
        assert set(parts) == {"small", "least", None} and abs(parts["small"] - 64) <= 3 and abs(parts["least"] - 32) <= 3


@pytest.mark.parametrize("bucket", [4_000_000, 3000])
def test_sources_beyond_the_queues_keep_their_proportions(spark, monkeypatch, bucket):
    monkeypatch.setattr(pk, "MAX_QUEUES", 2)
    monkeypatch.setattr(pk, "BUCKET_TOKENS", bucket)
    text = "stone river cloud lamp " * 3  # 13 tokens
    sizes = {"big": 400, "a": 200, "b": 100, "c": 50, None: 50}
    rows = [(k * 1000 + i, text, s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)] + [(9000 + i, text, f"single{i}") for i in range(40)]
    packed = pk.pack(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6), window=512).collect()
    check_packing(rows, packed, 512)
    every = sum(r.length for r in packed)
    for k in range(1, max(r.sequence_id for r in packed) + 1):
        got = defaultdict(int)
        for r in packed:
            if r.sequence_id == k:
                got["single" if (r.source or "").startswith("single") else r.source] += r.length
        for s, n in sizes.items():
            assert abs(got[s] - 512 * 13 * n / every) <= 2 * 13 + 2, (k, s)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=7), st.one_of(st.none(), st.lists(st.integers(0, 5), min_size=7, max_size=7)))
def test_windows_hold_each_token_once(totals, target):
    window = 64
    plan = pk.phases(totals, None if target is None else target[: len(totals)], window)
    fill = defaultdict(list)
    for q, t in enumerate(totals):
        parts = sorted(pk.pieces(q, 0, t, plan))
        assert sum(p[1] for p in parts) == t
        for a, n, k, o in parts:
            fill[k].append((o, n))
    assert sorted(fill) == list(range(-(-sum(totals) // window)))
    for k, parts in fill.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == window or k == 0


def test_store_round_trip(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(ts, "RANGE_BYTES", 4000)
    monkeypatch.setattr(ts, "INDEX_GROUP", 3)
    monkeypatch.setattr(ts, "BLOCK_DOCS", 5)
    folder = str(tmp_path / "store")
    ts.write_tokens(docs, folder)
    got = ts.read_tokens(spark, folder).collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, np.array(reference(r.text, 1), "<u4").tobytes()) for r in docs.collect()))
    back = sorted(got, key=lambda r: r.start)
    in_order = [(r.doc_id is not None, r.doc_id or 0) for r in back]
    assert in_order == sorted(in_order)
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids)) for r in back) == rows
    assert [r.start for r in back] == [sum(r.n_tokens for r in back[:k]) for k in range(len(back))]
    assert all(r.n_tokens == len(r.ids) // 4 for r in back)
    one = ts.read_tokens(spark, folder, doc_id=50).collect()
    assert len(one) == 1 and zlib.crc32(one[0].ids) == zlib.crc32(np.array(reference(None, 1), "<u4").tobytes())
    assert [r.start for r in back if r.doc_id == 50] == [one[0].start]


def test_files_are_in_order_and_one_id_fills_many_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ts, "RANGE_BYTES", 4000)
    rows = [(i, f"stone river {i} lamp") for i in range(300)] + [(7, f"cloud number {i}") for i in range(200)] + [(None, f"no id {i}") for i in range(150)] + [(9, "the same row")] * 150
    folder = str(tmp_path / "ordered")
    ts.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), folder)
    ids, sizes = [], []
    for f in sorted((tmp_path / "ordered" / "blocks").glob("*.parquet")):
        part = [x for b in pq.read_table(f).to_pylist() for x in [None] * b["null_ids"] + b["doc_ids"][b["null_ids"] :]]
        ids += part
        sizes.append(len(part))
    want = sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert ids == want and len(sizes) > 10 and max(sizes) < 120
    one = ts.read_tokens(spark, folder, doc_id=7).collect()
    assert len(one) == 201 and len(ts.read_tokens(spark, folder, doc_id=10**6).collect()) == 0
    back = sorted(ts.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in back] == want and back[-1].start + back[-1].n_tokens == sum(r.n_tokens for r in back)


@pytest.mark.parametrize("n", [0, 1])
def test_small_stores(spark, docs, empty, tmp_path, n):
    folder = str(tmp_path / f"store{n}")
    ts.write_tokens(docs.limit(1) if n else empty, folder)
    assert ts.read_tokens(spark, folder).count() == n


def test_empty_packing(empty):
    assert pk.pack(empty).count() == 0


def test_two_hundred_sources_keep_their_shares_to_a_token():
    """Documents of 20,000 tokens, longer than a window: each window holds of each source what is due, less than a token off; the largest fills up."""
    rng = random.Random(30)
    totals = [rng.randint(20_000, 60_000) for _ in range(199)] + [900_000]
    plan = pk.phases(totals)
    starts = [(q, at, min(20_000, t - at)) for q, t in enumerate(totals) for at in range(0, t, 20_000)]
    found = pk.cut_pieces(*(np.array(c) for c in zip(*starts, strict=True)), plan)
    got = defaultdict(int)
    for (q, _, _), flat in zip(starts, found, strict=True):
        for _, length, k, _ in flat.reshape(-1, 4).tolist():
            got[q, k] += length
    (full,) = [p for p in plan if p.tokens == pk.WINDOW]
    for k in range(full.first, full.first + full.windows):
        parts = [got[q, k] for q in range(200)]
        assert sum(parts) == pk.WINDOW and all(abs(n - full.take[q] / full.windows) < 1 for q, n in enumerate(parts[:-1]))


def test_long_documents_beyond_the_queues_come_in_parts(spark, monkeypatch):
    """Of sources in the shared queue no window gets much more than its share, though a document is longer than a window."""
    monkeypatch.setattr(pk, "MAX_QUEUES", 2)
    sizes = {"big": 40, "a": 10, "b": 5, "c": 5}
    rows = [(100 * k + i, "stone river cloud lamp " * 300, s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    packed = pk.pack(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), window=512).collect()
    check_packing(rows, packed, 512)
    got = defaultdict(int)
    for r in packed:
        got[r.source, r.sequence_id] += r.length
    for k in range(1, max(r.sequence_id for r in packed) + 1):
        for s, n in sizes.items():
            assert abs(got[s, k] - 512 * n / 60) <= 2 * pk.TAIL_PART
