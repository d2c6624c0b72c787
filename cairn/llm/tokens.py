"""Token ids of whole texts by the tokenizers library, encoding each distinct pre-token once.

For the tokenizer used here ids of a text are those of its pre-tokens in order. Texts of plain Latin characters are cut
into pre-tokens by numpy over the bytes of a whole batch and told apart by Arrow's dictionary encoding; distinct ones seen
before come from a bounded cache, and the library encodes all new ones of a batch in one call. Any other text goes to
the library as it is, and so does every text if the file has another normaliser, pattern or model. Both ways give the same ids.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from itertools import islice

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

#: Pre-tokens kept by a worker (some 90 MB), and those in one call of the library.
CACHE_WORDS, CALL_WORDS = 400_000, 1000
#: Not plain: characters from U+0250 on, controls, white space other than the four usual ones, those whose lower case is longer, and the beginning of special tokens.
_UNUSUAL = re.compile("[^\x20-\x7e\t\n\r\xa1-\xac\xae-\u012f\u0131-\u0239\u023b-\u023d\u023f-\u024f]|<\\|")
#: The parts of a tokenizer file that this module knows how to follow.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
_PLAIN_ASCII = bytes([9, 10, 13, *range(32, 127)])
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
#: Kinds of the plain characters by code point. A pre-token is a run of letters, one number, or a run of others.
_KIND = np.array([_SPACE if c.isspace() else _LETTER if c.isalpha() else _NUMBER if c.isnumeric() else _OTHER for c in map(chr, range(0x250))], np.uint8)
_BYTE_KIND = _KIND[:256]
#: What the tokenizer splits off behind an apostrophe.
_SHORT_ENDINGS, _LONG_ENDINGS = b"stmd", (b"re", b"ve", b"ll")


def is_plain(text: str) -> bool:
    """Whether a text is cut here; most characters of most texts are settled by deleting ASCII ones.

    Its lower-cased characters have to be plain as well: those of some capitals below U+0250 are above.
    """
    rest = text.encode().translate(None, _PLAIN_ASCII).decode()
    return "<|" not in text and not (rest and (_UNUSUAL.search(rest) or _UNUSUAL.search(rest.lower())))


def is_known(path: str) -> bool:
    """Whether the file cuts texts as this module does: same normaliser and pattern, byte-level word ends, no prefix, special tokens in ``<|``."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    model, cut = made.get("model") or {}, made.get("pre_tokenizer") or {}
    cuts = cut.get("pretokenizers") or [{}, {}]
    return (
        (made.get("normalizer") or {}).get("normalizers") == _NORMALIZERS
        and len(cuts) == 2
        and (cuts[0].get("type"), cuts[0].get("pattern"), cuts[0].get("behavior"), cuts[0].get("invert")) == ("Split", _SPLIT, "Removed", True)
        and (cuts[1].get("type"), cuts[1].get("add_prefix_space"), cuts[1].get("use_regex")) == ("ByteLevel", False, False)
        and model.get("type") == "BPE"
        and model.get("end_of_word_suffix") == "</w>"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "unk_token", "fuse_unk", "byte_fallback", "ignore_merges"))
        and not made.get("truncation")
        and all(t["content"].startswith("<|") and not t["normalized"] for t in made.get("added_tokens") or ())
    )


def pretoken_starts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lower-cased UTF-8 bytes of plain characters, which end in three newlines: which are the first of a pre-token, and which belong to one."""
    kind = _BYTE_KIND[data]
    wide = np.flatnonzero(data >= 0xC2)
    kind[wide] = kind[wide + 1] = _KIND[(data[wide].astype(np.int64) & 31) << 6 | data[wide + 1] & 63]
    starts = np.ones(len(data), bool)
    starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    starts[wide + 1] = False
    marks = np.flatnonzero(data == ord("'"))
    marks = marks[starts[marks]]
    after, second = data[marks + 1], data[marks + 2]
    long = np.zeros(len(marks), bool)
    for x, y in _LONG_ENDINGS:
        long |= (after == x) & (second == y)
    for found, n in ((np.isin(after, list(_SHORT_ENDINGS)), 1), (long, 2)):
        starts[marks[found] + 1] = False
        starts[marks[found] + n + 1] = True
    inside = kind != _SPACE
    return starts & inside, inside


def public_tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self.path, self.full, self.words = path, None, {}
        self.known = is_known(path)
        if not self.known:
            return
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.bare.get_vocab(True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _whole(self, texts: list[str]) -> list[bytes]:
        if self.full is None:  # few workers need it
            self.full = Tokenizer.from_file(self.path)
        return [np.array(e.ids, "<u4").tobytes() for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, fresh: list[str]) -> None:
        """Add pre-tokens to the cache: many are encoded together, and their ids are cut at the ends that the vocabulary marks."""
        calls = [fresh[i : i + CALL_WORDS] for i in range(0, len(fresh), CALL_WORDS)]
        for parts, encoded in zip(calls, self.bare.encode_batch_fast([" ".join(c) for c in calls], add_special_tokens=False), strict=True):
            ids = np.array(encoded.ids, "<u4")
            stops = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(stops) == len(parts):
                raw = ids.tobytes()
                self.words.update(zip(parts, [raw[i:j] for i, j in zip([0, *stops], stops, strict=False)], strict=True))
            else:
                single = self.bare.encode_batch_fast(parts, add_special_tokens=False)
                self.words.update(zip(parts, [np.array(e.ids, "<u4").tobytes() for e in single], strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; none for null and empty ones."""
        out = [b""] * len(texts)
        plain, odd = [], []
        for i, t in enumerate(texts):
            if t:
                (plain if self.known and is_plain(t) else odd).append(i)
        if plain:
            for i, b in zip(plain, self._plain([texts[i].lower().encode() for i in plain]), strict=True):
                out[i] = b
        if odd:
            for i, b in zip(odd, self._whole([texts[i] for i in odd]), strict=True):
                out[i] = b
        return out

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        joined = b"\n".join([*texts, b"\n\n"])
        data = np.frombuffer(joined, np.uint8)
        starts, inside = pretoken_starts(data)
        # Without white space, half of all runs, pre-tokens lie side by side as Arrow keeps texts.
        packed, cuts = data[inside], np.flatnonzero(starts)
        offsets = np.append(np.flatnonzero(starts[inside]), len(packed)).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_string(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.words.get, words))
        fresh = [i for i, b in enumerate(found) if b is None]
        if len(self.words) + len(fresh) > CACHE_WORDS:
            # Common words come early, so the older half stays.
            self.words = dict(islice(self.words.items(), CACHE_WORDS // 2))
        self._learn([words[i] for i in fresh])
        for i in fresh:
            found[i] = self.words[words[i]]
        ids = pa.array(found, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(cuts) + 1)
        raw = memoryview(ids.buffers()[2] or b"")
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        edges = ends[np.searchsorted(cuts, begins)].tolist()
        return [bytes(raw[i:j]) for i, j in zip(edges, edges[1:], strict=False)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encode_in_parts(path: str, texts: list[str | None], characters: int = 4 << 20) -> Iterable[bytes]:
    """Ids of each text; so many characters at a time bound the memory."""
    part: list[str | None] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= characters:
            yield from encoder(path).encode(part)
            part, size = [], 0
    yield from encoder(path).encode(part)
