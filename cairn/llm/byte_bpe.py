"""Byte-level BPE: texts to ids and back.

A text is cut into words; distinct words are merged once for a batch and kept in a bounded cache. A word's adjacent pairs are
the leaves of a segment tree, each with its merge rank and place. The root is the leftmost pair of lowest rank; a merge changes three
leaves and the nodes above them, until no pair of the word can be merged. Short words of a batch are merged side by side in numpy, a tree
a row; a long one has a tree of its own.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import refuse, require, text_batches, whole_text
from .tokens import public_tokenizer_path

#: Fixed value: where the file's pre-tokenizer cuts texts.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept by a worker, length of the longest that is kept, words cut from a text at a time, and slots of trees that are merged side by side.
CACHE_WORDS, CACHED_LENGTH, WORDS_AT_ONCE, SLOTS_AT_ONCE = 200_000, 64, 200_000, 1 << 20
#: Trees of so many leaves are merged side by side; longer words one by one.
WIDTHS = (4, 8, 16, 32, 64)
NO_PAIR = np.int64(2**62)


def byte_characters() -> list[str]:
    """The character of each byte: printable ones of Latin-1 stand for themselves, the others for those from U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class ByteBpe:
    """A tokenizer file of the byte-level kind: no normaliser, no prefix blank, special tokens taken as they stand."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, cut = made["model"], made.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or odd or made.get("normalizer") or (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) != ("ByteLevel", False, True):
            raise ValueError(f"{path} isn't a plain byte-level BPE file")
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in made.get("added_tokens") or ()):
            raise ValueError(f"{path} has added tokens that depend on what is around them")
        characters = byte_characters()
        byte_of = {c: b for b, c in enumerate(characters)}
        vocabulary: dict[str, int] = model["vocab"]
        self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in made.get("added_tokens") or ()}
        raw = {i: bytes(byte_of[c] for c in t) for t, i in vocabulary.items()} | {t["id"]: t["content"].encode() for t in made.get("added_tokens") or ()}
        self.none = max(raw) + 1  # stands for no symbol
        self.lengths = np.array([len(raw.get(i, b"")) for i in range(self.none)], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(raw.get(i, b"") for i in range(self.none)), np.uint8)
        self.of_byte = np.array([vocabulary[c] for c in characters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merged = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        self.rank_of = {self.pair(vocabulary[a], vocabulary[b]): r for r, (a, b) in enumerate(merges)}
        keys = np.fromiter(self.rank_of, np.int64, len(self.rank_of))
        order = np.argsort(keys)
        self.keys, self.key_ranks = keys[order], np.fromiter(self.rank_of.values(), np.int64, len(keys))[order]
        self.word = regex.compile(WORD)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words: dict[str, bytes] = dict(self.special)  # no word is a special token, as those are cut out first

    def pair(self, left, right):
        return left * (self.none + 1) + right

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs, NO_PAIR where they can't be merged."""
        key = self.pair(left, right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_ranks[at], NO_PAIR)

    def merge_short(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids of words of fewer than ``width`` bytes. Slot ``width`` - 1 of each row is the edge, which no pair includes."""
        n, edge = len(words), width - 1
        sizes = np.fromiter(map(len, words), np.int64, n)
        symbols = np.full((n, width), self.none, np.int64)
        symbols[np.arange(width) < sizes[:, None]] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        before = np.tile(np.arange(-1, edge), (n, 1))
        before[:, 0] = edge
        after = np.tile(np.minimum(np.arange(1, width + 1), edge), (n, 1))
        tree = np.full((n, 2 * width), NO_PAIR, np.int64)
        first = self.ranks(symbols[:, :-1], symbols[:, 1:])
        tree[:, width:-1] = np.where(first < NO_PAIR, first * width + np.arange(edge), NO_PAIR)
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        alive = symbols != self.none
        row = np.flatnonzero(tree[:, 1] < NO_PAIR)
        while len(row):
            rank, at = np.divmod(tree[row, 1], width)
            gone = after[row, at]
            behind, ahead = before[row, at], after[row, gone]
            alive[row, gone] = False
            symbols[row, at] = self.merged[rank]
            after[row, at], before[row, ahead] = ahead, at
            # A row's three leaves are changed, then the nodes above them level by level.
            for slot, right in ((behind, at), (at, ahead)):
                own = self.ranks(symbols[row, slot], symbols[row, right])
                tree[row, width + slot] = np.where((own < NO_PAIR) & (slot != edge), own * width + slot, NO_PAIR)
            tree[row, width + gone] = NO_PAIR
            rows, nodes = np.tile(row, 3), np.concatenate([behind, at, gone]) + width
            while nodes[0] > 1:
                nodes >>= 1
                tree[rows, nodes] = np.minimum(tree[rows, 2 * nodes], tree[rows, 2 * nodes + 1])
            row = row[tree[row, 1] < NO_PAIR]
        ids, ends = symbols[alive].astype("<u4"), np.cumsum(alive.sum(1)).tolist()
        return [ids[i:j].tobytes() for i, j in zip([0, *ends], ends, strict=False)]

    def merge_long(self, word: bytes) -> bytes:
        """Ids of one word; it takes some 40 bytes for each of its bytes."""
        n = len(word)
        width = 1 << n.bit_length()
        symbols = array("q", self.of_byte[np.frombuffer(word, np.uint8)].tobytes())
        before, after = array("q", range(-1, n - 1)), array("q", range(1, n + 1))
        none, tree = int(NO_PAIR), array("q", [int(NO_PAIR)]) * (2 * width)
        leaf = lambda i: none if after[i] >= n or (r := self.rank_of.get(self.pair(symbols[i], symbols[after[i]]))) is None else r * width + i
        for i in range(n - 1):
            tree[width + i] = leaf(i)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] < none:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            symbols[at], after[at] = int(self.merged[rank]), after[gone]
            if after[at] < n:
                before[after[at]] = at
            after[gone] = n + 1  # no symbol any more
            for i in (gone, at, before[at]):
                if i >= 0:
                    node = width + i
                    tree[node] = none if i == gone else leaf(i)
                    while node > 1:
                        node >>= 1
                        low = min(tree[2 * node], tree[2 * node + 1])
                        if tree[node] == low:
                            break  # nothing changes above
                        tree[node] = low
        return np.array([s for s, a in zip(symbols, after, strict=True) if a <= n], "<u4").tobytes()

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        out = [b""] * len(words)
        classes = np.searchsorted(WIDTHS, np.fromiter(map(len, words), np.int64, len(words)) + 1)
        for k, width in enumerate(WIDTHS):
            chosen = np.flatnonzero(classes == k).tolist()
            for i in range(0, len(chosen), SLOTS_AT_ONCE // width):
                part = chosen[i : i + SLOTS_AT_ONCE // width]
                for j, ids in zip(part, self.merge_short([words[j] for j in part], width), strict=True):
                    out[j] = ids
        for j in np.flatnonzero(classes == len(WIDTHS)).tolist():
            out[j] = self.merge_long(words[j])
        return out

    def blocks(self, text: str) -> Iterator[list[str]]:
        """The text's words and special tokens in order, so many at a time."""
        at = 0
        for special in [*(self.cut.finditer(text) if self.cut else ()), None]:
            part = text[at : special.start()] if special else text[at:]
            if len(part) <= WORDS_AT_ONCE:
                yield self.word.findall(part)
            else:
                found = (m.group() for m in self.word.finditer(part))
                while block := list(islice(found, WORDS_AT_ONCE)):
                    yield block
            if special:
                yield [special.group()]
                at = special.end()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; none for null and empty ones. New words of many texts are merged together, those of a long one in parts."""
        out: list[list[bytes]] = [[] for _ in texts]
        pending: list[tuple[int, list[str]]] = []
        size = 0

        def settle() -> None:
            fresh = list(set().union(*[block for _, block in pending]).difference(self.words))
            self.words.update(zip(fresh, self.merge([w.encode() for w in fresh]), strict=True))
            for i, block in pending:
                out[i].append(b"".join(map(self.words.__getitem__, block)))
            for w in fresh:
                if len(w) > CACHED_LENGTH:
                    del self.words[w]
            if len(self.words) > CACHE_WORDS:
                self.words = dict(islice(self.words.items(), CACHE_WORDS // 2))  # special tokens and common words come early
            pending.clear()

        for i, text in enumerate(texts):
            for block in self.blocks(text) if text else ():
                pending.append((i, block))
                size += len(block)
                if size >= WORDS_AT_ONCE:
                    settle()
                    size = 0
        settle()
        return [b"".join(parts) for parts in out]

    def decode(self, ids: bytes) -> str:
        """The text of ids; unknown ones are left out, and bytes that are no UTF-8 become U+FFFD."""
        parts = []
        for at in range(0, len(ids), 4 * WORDS_AT_ONCE):
            known = np.frombuffer(ids[at : at + 4 * WORDS_AT_ONCE], "<u4").astype(np.int64)
            known = known[known < self.none]
            n = self.lengths[known]
            parts.append(self.flat[np.repeat(self.starts[known] - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes())
        return b"".join(parts).decode("utf-8", "replace")


_loaded: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    """One for each worker and file."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def encode_texts(docs: DataFrame, *, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (little-endian unsigned 32-bit integers) and ``n_tokens``.

    Ids are those of the tokenizers library without special tokens, truncation and padding; the strings of special tokens in a text get their
    ids. Null and empty texts have none; long ones are cut in parts. Repeated rows and ties are encoded each by itself; an empty table stays
    empty. Other columns stay; one called ``ids`` or ``n_tokens`` is an error.
    """
    require(docs, [text_col])
    refuse(docs.columns, ["ids", "n_tokens"])
    text_batches(docs.sparkSession)
    path = path or public_tokenizer_path("byte_bpe_50k.json")

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(loaded(path).encode(texts.tolist()), dtype=object)

    coded = docs.withColumn("ids", encode(whole_text(text_col)))
    return coded.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def decode_ids(docs: DataFrame, *, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` with ``decoded``, the text of their ids, special tokens included; null ids give null. A column called ``decoded`` is an error."""
    require(docs, [ids_col])
    refuse(docs.columns, ["decoded"])
    text_batches(docs.sparkSession)
    path = path or public_tokenizer_path("byte_bpe_50k.json")

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in batches:
            yield pd.Series([None if x is None else loaded(path).decode(bytes(x)) for x in ids], dtype=object)

    return docs.withColumn("decoded", decode(ids_col))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens and the digests of its ids and of the text made of them; odd rows as in :func:`encode_texts`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode_texts(docs).select("doc_id", "n_tokens", "ids")
    return decode_ids(coded).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
