"""Counts of hashed words and character n-grams of many texts at once, without a Python loop over words."""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = np.cumprod(np.full(64, 0x100000001B3, np.uint64), dtype=np.uint64)


def word_spans(raw: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that belong to words."""
    step = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(raw: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the words' starts. Bytes beyond a word's 64th wrap to the first powers."""
    starts, ends = word_spans(raw, inside)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    sizes = ends - starts
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    values = (raw[inside].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 63]
    h = np.add.reduceat(values, np.cumsum(sizes) - sizes)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32)), starts


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with a line break after each, and where each begins."""
    pieces = [x.encode("utf-8", "replace") + b"\n" for x in texts]
    sizes = np.array([len(x) for x in pieces], np.int64)
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, dtype=np.float64) if len(starts) else np.zeros(0)


#: Statistics of a text's structure, in the order of the columns that structure() returns.
STATISTICS = ("log_chars", "log_words", "word_length", "upper", "digit", "sign", "high", "lines_per_word", "repeats", "variety", "top_sign", "short_words")


def structure(raw: np.ndarray, begins: np.ndarray, hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(texts, STATISTICS) from bytes, word hashes with their starts, and counts of hashed words."""
    n = len(begins)
    size = np.diff(np.append(begins, len(raw))).astype(float)
    bytes_ = np.maximum(size - 1, 1)
    of = np.searchsorted(begins, starts, "right") - 1
    words = np.bincount(of, minlength=n).astype(float)
    some = np.maximum(words, 1)
    white = _WHITE[raw]
    upper, digit, high = (raw >= 65) & (raw <= 90), (raw >= 48) & (raw <= 57), raw >= 128
    sign = ~white & ~upper & ~digit & ~high & ~((raw >= 97) & (raw <= 122))
    same = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1]) if len(hashes) else np.zeros(0, bool)
    pairs = (raw[1:] == raw[:-1]) & sign[1:]
    # Up to the next word or the end of the own text: a score must not depend on which text comes next.
    next_white = np.minimum(np.append(starts[1:], len(raw)), np.append(begins[1:], len(raw))[of]) - starts
    out = np.empty((n, len(STATISTICS)), np.float32)
    out[:, 0] = np.log1p(size - 1)
    out[:, 1] = np.log1p(words)
    out[:, 2] = np.log1p((bytes_ - _sums(white, begins) + 1) / some)
    for k, x in ((3, upper), (4, digit), (5, sign), (6, high)):
        out[:, k] = _sums(x, begins) / bytes_
    out[:, 7] = _sums(raw == 10, begins) / some
    out[:, 8] = np.bincount(of[1:][same], minlength=n) / some if len(hashes) else 0
    out[:, 9] = (counts > 0).sum(axis=1) / np.minimum(some, counts.shape[1])
    out[:, 10] = _sums(np.append(False, pairs), begins) / bytes_
    out[:, 11] = np.bincount(of[next_white <= 4], minlength=n) / some
    return out


def word_counts(raw: np.ndarray, begins: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts (texts, buckets) of lower-cased words cut at ASCII white space, the words' hashes and starts."""
    low = _LOWER[raw]
    hashes, starts = word_hashes(low, ~_WHITE[low])
    of = np.searchsorted(begins, starts, "right") - 1
    flat = np.bincount(of * buckets + (hashes % np.uint64(buckets)).astype(np.int64), minlength=len(begins) * buckets)
    return flat.reshape(len(begins), buckets).astype(np.float32), hashes, starts


def gram_counts(texts: list[str], buckets: int, orders: tuple[int, ...] = (1, 2, 3), slice_: int = 1_000_000) -> np.ndarray:
    """Counts (texts, buckets) of the hashed n-grams of the lower-cased texts' code points, ASCII other than
    letters taken as spaces. A text
    longer than a slice is counted slice by slice."""
    out = np.zeros((len(texts), buckets), np.float32)
    group: list[tuple[int, str]] = []
    held = 0
    for i, text in enumerate(texts):
        text = f" {text.lower()} "
        over = max(orders) - 1
        for at in range(0, max(1, len(text) - over), slice_):
            part = text[at : at + slice_ + over]
            if group and held + len(part) > slice_:
                _count(group, out, buckets, orders)
                group, held = [], 0
            group.append((i, part))
            held += len(part)
            if at + slice_ < len(text) - over:  # the next part of this text repeats the last letters for longer n-grams only
                _count(group, out, buckets, orders, over)
                group, held = [], 0
    if group:
        _count(group, out, buckets, orders)
    return out


def _count(group: list[tuple[int, str]], out: np.ndarray, buckets: int, orders: tuple[int, ...], over: int = 0) -> None:
    """Adds the n-grams that lie in one part; with over, those that begin in its last letters are the next part's."""
    codes = np.frombuffer("".join(p for _, p in group).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where((codes < 128) & ((codes < 97) | (codes > 122)), np.uint32(32), codes)
    sizes = np.array([len(p) for _, p in group])
    rows = np.arange(len(group))
    flat = np.zeros(len(group) * buckets, np.int64)
    ends = np.cumsum(sizes)
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, max(orders) + 1):
        last = len(codes) - n + 1
        if last <= 0:
            break
        h = (h[:last] * np.uint32(0x01000193)) ^ (codes[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n))
        if n not in orders:
            continue
        mixed = h ^ (h >> np.uint32(15))
        mixed = mixed * np.uint32(0x85EBCA6B)
        bucket = ((mixed ^ (mixed >> np.uint32(13))) & np.uint32(buckets - 1)).astype(np.int64)
        valid = np.maximum(sizes - (max(n - 1, over)), 0)
        if (valid == sizes).all():
            bucket += np.repeat(rows * buckets, sizes)[:last]
        else:
            keep = np.repeat(ends - sizes - (np.cumsum(valid) - valid), valid) + np.arange(valid.sum())
            bucket = bucket[keep] + np.repeat(rows * buckets, valid)
        flat += np.bincount(bucket, minlength=len(flat))
    np.add.at(out, [i for i, _ in group], flat.reshape(len(group), buckets))
