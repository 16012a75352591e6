"""Token ids from a tokenizers file, with a cache of the ids of pre-tokens.

Both BPE files merge inside a pre-token only, so the ids of a text are those of its pre-tokens in order. For plain
texts (`_odd` says which are not) the pre-tokens are cut here, many texts at once, by classes of bytes; each new pre-token is encoded by
the tokenizers library and its ids are kept. Every other text goes to the library whole, and so does one that holds the
string of a special token. That string becomes the token's id, as the library does by itself, or with plain=True the ids
of ordinary text.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: The pattern that the byte-level pre-tokenizer has built in (fixed value); the byte classes below follow it.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The pattern of the word pre-tokenizer (fixed value).
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pre-tokens of a generation of the cache. At most two generations are kept; what was used since the last change stays.
KEEP = 450_000
#: New pre-tokens that go to the library as one text.
JOIN = 512

_LETTER, _DIGIT, _SPACE, _SIGN = 1, 2, 3, 4
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[10, 32]] = _SPACE

#: Bytes of characters that the classes do not cover: controls, apostrophes (contractions), all beyond the Latin letters
#: up to U+024F, which normalisation leaves as they are.
_ODD = np.zeros(256, bool)
_ODD[[*range(10), *range(11, 32), 39, 127, 192, 193, 194, *range(202, 256)]] = True

_OPEN: dict[tuple[str, bool], "Encoder"] = {}


def encoder(path: str, plain: bool = False) -> "Encoder":
    """One encoder for each file and process; Spark's reused Python workers keep it from task to task."""
    if (path, plain) not in _OPEN:
        _OPEN[path, plain] = Encoder(path, plain)
    return _OPEN[path, plain]


class Encoder:
    def __init__(self, path: str, plain: bool = False):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        self.special = [] if plain else [x["content"] for x in spec.get("added_tokens") or []]
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.fast, self.words, self.mark, self.last = False, False, -1, None
        before, cut = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        if before is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space"):
            newline = self.library.encode("\n", add_special_tokens=False).ids
            self.fast, self.mark = len(newline) == 1, newline[0]
        elif before and [x["type"] for x in before.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cut.get("pretokenizers", [])] == ["Split", "ByteLevel"]:
            split, level = cut["pretokenizers"]
            self.fast = self.words = split["behavior"] == "Removed" and split["invert"] and split["pattern"].get("Regex") == _WORDS and not level["use_regex"] and not level["add_prefix_space"]
            self.last = np.zeros(self.library.get_vocab_size(), bool)
            self.last[[i for token, i in self.library.get_vocab().items() if token.endswith(spec["model"]["end_of_word_suffix"] or "\0")]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers; no special tokens."""
        out: list[bytes] = [b""] * len(texts)
        there = [i for i, x in enumerate(texts) if x]
        odd = self._odd([texts[i].encode() for i in there]) if self.fast and there else [True] * len(there)
        # Case and form may change before the library looks for special tokens, so a text is asked as it is and lower-cased.
        low = [texts[i].lower() if self.words or self.special else "" for i in there]
        odd = [o or any(x in texts[i] or x in y for x in self.special) for i, o, y in zip(there, odd, low, strict=True)]
        plain, rest = [i for i, o in zip(there, odd, strict=True) if not o], [i for i, o in zip(there, odd, strict=True) if o]
        if plain:
            cut = [(y if self.words else texts[i]).encode() for i, o, y in zip(there, odd, low, strict=True) if not o]
            for i, ids in zip(plain, self._cut(cut), strict=True):
                out[i] = ids
        for at in range(0, len(rest), 32):
            some = rest[at : at + 32]
            for i, ids in zip(some, self._single([texts[i] for i in some]), strict=True):
                out[i] = ids
        return out

    def _odd(self, texts: list[bytes]) -> list[bool]:
        """Whether a text has what the classes do not cover; so has one with two white-space characters in a row."""
        raw = np.frombuffer(b"".join(texts), np.uint8)
        odd = _ODD[raw]
        white = (raw == 32) | (raw == 10)
        odd[1:] |= white[1:] & white[:-1]
        odd[1:] |= (raw[:-1] == 195) & ((raw[1:] == 151) | (raw[1:] == 183)) | (raw[:-1] == 196) & ((raw[1:] == 176) | (raw[1:] == 177))
        edges = np.cumsum([len(x) for x in texts])
        return (np.add.reduceat(odd, np.append(0, edges[:-1]), dtype=np.int64) > 0).tolist()

    def _cut(self, texts: list[bytes]) -> list[bytes]:
        raw = np.frombuffer(b"".join(texts), np.uint8)
        edges = np.cumsum([len(x) for x in texts])
        kind = _CLASS[raw]
        start = np.ones(len(raw), bool)
        if self.words:  # a digit stands alone; white space has no ids
            start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        else:  # a space goes with what follows
            start[1:] = (kind[1:] != kind[:-1]) & ((raw[:-1] != 32) | (kind[1:] == _SPACE))
        start[edges[:-1]] = True
        starts = np.flatnonzero(start)
        offsets = pa.py_buffer(np.append(starts, len(raw)).astype(np.int32))
        units = pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(raw)]).dictionary_encode()
        # Arrow joins the ids of all units; its lists of Python's bytes are slow, numpy's are not.
        known = self._known(units.dictionary.to_numpy(zero_copy_only=False).tolist())
        _, ends, ids = pa.array(known, pa.large_binary()).take(units.indices).buffers()
        stops = np.frombuffer(ends, np.int64)[np.searchsorted(starts, edges)].tolist()
        view = memoryview(ids or b"")
        return [bytes(view[a:b]) for a, b in zip([0, *stops], stops)]

    def _known(self, words: list[bytes]) -> list[bytes]:
        if len(self.cache) > KEEP:
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        out = list(map(cache.get, words))
        if None in out:
            missed = [w for w, ids in zip(words, out, strict=True) if ids is None]
            cache.update({w: older[w] for w in missed if w in older})
            if new := [w for w in missed if w not in cache]:
                self._new(new)
            out = [cache[w] if ids is None else ids for w, ids in zip(words, out, strict=True)]
        return out

    def _single(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, units: list[bytes]) -> None:
        """Encodes pre-tokens, many as one text. Between them stands what never joins with them: a line break, whose id
        then parts them, or a space, which has no id, where each pre-token's last id is of a word end."""
        apart = [w for w in units if w.isspace()]
        self.cache.update(zip(apart, self._single([w.decode() for w in apart]), strict=True))
        units = [w for w in units if not w.isspace()]
        groups = [units[i : i + JOIN] for i in range(0, len(units), JOIN)]
        joined = self.library.encode_batch_fast([(b" " if self.words else b"\n").join(g).decode() for g in groups], add_special_tokens=False)
        for some, e in zip(groups, joined, strict=True):
            ids = np.array(e.ids, "<u4")
            if self.words:
                ends = np.flatnonzero(self.last[ids]) + 1
                starts = np.append(0, ends[:-1])
            else:
                ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
                starts = np.append(0, ends[:-1] + 1)
            if len(ends) != len(some) or (starts >= ends).any():
                self.cache.update(zip(some, self._single([w.decode() for w in some]), strict=True))
                continue
            raw = ids.tobytes()
            for w, a, b in zip(some, (starts * 4).tolist(), (ends * 4).tolist(), strict=True):
                self.cache[w] = raw[a:b]
