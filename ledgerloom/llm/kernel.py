"""Whole-batch text kernels on Arrow buffers: one pass of array operations instead of a Python loop per word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_PRIME = np.uint64(0x100000001B3)
_U = np.uint64


def _byte_map() -> np.ndarray:
    """Lower-cased letters and digits keep a value, bytes of multi-byte characters too; all else is 0."""
    m = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 128 or c.isascii() and c.isalnum():
            m[b] = ord(c.lower()) if b < 128 else b
    return m


_MAP = _byte_map()
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all input bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Words:
    """The words of a batch of texts, in order: hash, text number, and byte span in the cleaned buffer."""

    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    length: np.ndarray
    data: np.ndarray

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.start[i] + self.length[i]].tobytes().decode("utf-8", "replace")

    def is_number(self) -> np.ndarray:
        """True for words that begin with a digit."""
        return _DIGIT[self.data[self.start]] if len(self.start) else np.zeros(0, bool)


def _edit(texts: pa.Array, mask: pa.Array, change) -> pa.Array:
    """Apply ``change`` to the texts under ``mask`` only."""
    return pc.replace_with_mask(texts, mask, change(texts.filter(mask))) if pc.any(mask).as_py() else texts


def clean(texts: pa.Array, han: bool = True) -> pa.Array:
    """Escape residue and Unicode punctuation become spaces, letters lower case, each Han or kana sign a word of its own.

    The regular expressions are applied only to texts that hold such characters. Null becomes the empty text.
    """
    texts = pc.fill_null(texts, "")
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    texts = _edit(texts, pc.match_substring(texts, "\\"), lambda t: pc.replace_substring_regex(t, r"\\+[nrt]", " "))

    def unfold(t: pa.Array) -> pa.Array:
        t = pc.replace_substring_regex(pc.utf8_lower(t), r"[^\p{L}\p{N}\p{M}\x00-\x7f]+", " ")
        return pc.replace_substring_regex(t, r"([\p{Han}\p{Hiragana}\p{Katakana}])", r" \1 ") if han else t

    return _edit(texts, pc.invert(pc.string_is_ascii(texts)), unfold)


def words(texts: pa.Array, join_figures: bool = True, han: bool = True) -> Words:
    """Words as runs of letters and digits, hashed eight bytes at a time; thousands separators inside a figure are skipped if asked."""
    texts = clean(texts, han)
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    low = _MAP[data]
    if join_figures and len(data) > 2:
        comma = np.flatnonzero(data[1:-1] == 44) + 1
        comma = comma[_DIGIT[data[comma - 1]] & _DIGIT[data[comma + 1]]]
        comma = comma[~np.isin(comma, offsets) & ~np.isin(comma + 1, offsets)] if len(comma) else comma
        if len(comma):
            low = np.delete(low, comma)
            offsets = offsets - np.searchsorted(comma, offsets)
    inside = low != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(low))]
    begins[cut] = inside[cut]
    start = np.flatnonzero(begins)
    if not len(start):
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), z, z, z, low)
    ends = inside
    ends[:-1] &= ~inside[1:] | begins[1:]
    length = np.flatnonzero(ends) + 1 - start
    row = np.repeat(np.arange(n), np.diff(np.searchsorted(start, offsets)))
    return Words(_hash_words(low, start, length), row, start, length, low)


_LOW_BYTES = np.array([0xFFFFFFFFFFFFFFFF >> (8 * (8 - k)) for k in range(1, 9)], np.uint64)


def _hash_words(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from its bytes in groups of eight."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), np.uint64, padded, strides=(1,))
    hashed = mix((eight[start] & _LOW_BYTES[np.minimum(length, 8) - 1]) + length.astype(np.uint64))
    todo, done = np.flatnonzero(length > 8), 8
    while len(todo):
        left = length[todo] - done
        chunk = eight[start[todo] + done] & _LOW_BYTES[np.minimum(left, 8) - 1]
        hashed[todo] = mix(hashed[todo] * _PRIME + chunk)
        todo, done = todo[left > 8], done + 8
    return hashed


def suffix_ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by prefix doubling: element k ranks them by their first 2**k symbols; the last by the whole suffix.

    ``symbols`` are non-negative integers; suffixes that end sooner rank lower.
    """
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    levels, width = [rank], 1
    while n and rank.max() < n - 1:
        after = np.full(n, -1, np.int64)
        if width < n:
            after[: n - width] = rank[width:]
        pair = rank * (n + 1) + after + 1
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        levels.append(rank)
        width *= 2
    return levels


def common_prefixes(left: np.ndarray, right: np.ndarray, levels: list[np.ndarray], lead: bool = False) -> np.ndarray:
    """The number of symbols that the suffixes at ``left`` and ``right`` share at their start; with ``lead``, after a first 0."""
    n = len(levels[0])
    a, b, total = left.copy(), right.copy(), np.zeros(len(left), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        step = (1 << k) * same
        total += step
        a += step
        b += step
    return np.concatenate([[0], total]) if lead else total
