"""Repetition inside one text: maximal repeats from a suffix array with longest common prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import kernel
from ledgerloom.session import spread

#: Words that a phrase must have, and the share of repeated words from which a text counts as repetitive.
MIN_WORDS, MIN_SHARE = 4, 0.4
#: Words whose suffixes are sorted together; a longer text is sorted alone.
BLOCK_WORDS = 200_000
_STEP = r"(?mi)^[\s>*\-•]*(?:step\s*|schritt\s*|paso\s*|étape\s*)?\d{1,3}\s*[:.)]\s"
SCHEMA = "repeat_words long, repeat_share double, longest_repeat long"


def measure(texts: pa.Array, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: its words, the words covered by repeats of at least ``min_words`` said before, and the longest repeat.

    All texts of the batch share one suffix array; a separator of its own after each text keeps matches inside the text.
    Each position that lies in an interval of ``min_words`` or more shared words with an earlier one begins a maximal repeat,
    as long as the deepest such interval; the union of these spans is covered, and the longest of them reported. (Every word of
    such a span lies in a run of ``min_words`` said before, so the covered count equals that of the repeated runs.)
    """
    n_texts = len(texts)
    w = kernel.words(pc.replace_substring_regex(pc.fill_null(texts, ""), _STEP, " "))
    count = np.bincount(w.row, minlength=n_texts)
    covered, longest = np.zeros(n_texts, np.int64), np.zeros(n_texts, np.int64)
    if len(w.hash) < min_words:
        return count, covered, longest
    wanted = _texts_with_repeats(w.hash, w.row, n_texts, min_words)
    use = wanted[w.row]
    hashes, rows = w.hash[use], w.row[use]
    ends = np.cumsum(np.where(wanted, count, 0))
    lo = 0
    while lo < n_texts:
        base = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + BLOCK_WORDS, side="right")))
        part = slice(base, int(ends[hi - 1]))
        if part.stop > part.start:
            _block(hashes[part], rows[part], lo, hi, min_words, covered, longest)
        lo = hi
    return count, covered, longest


def _texts_with_repeats(hashes: np.ndarray, rows: np.ndarray, n_texts: int, min_words: int) -> np.ndarray:
    """The texts in which some run of ``min_words`` words occurs twice; in all others no interval can exist."""
    n = len(hashes) - min_words + 1
    gram = rows[:n].astype(np.uint64)
    for k in range(min_words):
        gram = kernel.mix(gram * np.uint64(31) + hashes[k : n + k])
    same_text = np.flatnonzero(rows[:n] == rows[min_words - 1 :])
    gram = gram[same_text]
    order = np.argsort(gram)
    twice = np.flatnonzero(gram[order][1:] == gram[order][:-1])
    found = np.zeros(n_texts, bool)
    found[rows[same_text[order[twice]]]] = True
    return found


def _block(hashes, rows, lo, hi, min_words, covered, longest) -> None:
    """Suffix array, intervals and spans of the texts ``lo`` to ``hi``; adds to ``covered`` and ``longest``."""
    ids = np.unique(hashes, return_inverse=True)[1].astype(np.int64)
    n_sep = hi - lo
    symbols = np.full(len(ids) + n_sep, -1, np.int64)
    symbols[np.arange(len(ids)) + (rows - lo)] = ids + n_sep
    gaps = np.flatnonzero(symbols < 0)
    symbols[gaps] = np.arange(n_sep)
    text_of = np.repeat(np.arange(lo, hi), np.diff(np.concatenate([[-1], gaps])))
    levels = kernel.suffix_ranks(symbols)
    # The suffix array of each text by itself, one after another; across texts nothing is shared.
    order = np.lexsort((levels[-1], text_of))
    owner = text_of[order]
    shared = np.zeros(len(order), np.int64)
    same = np.flatnonzero(owner[1:] == owner[:-1]) + 1
    shared[same] = kernel.common_prefixes(order[same - 1], order[same], levels)
    repeat = np.zeros(len(order), np.int64)
    repeat[order] = said_before(order, shared)
    later = np.flatnonzero(repeat >= min_words)
    mark = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(mark, later, 1)
    np.add.at(mark, later + repeat[later], -1)
    hit = np.cumsum(mark[:-1]) > 0
    np.add.at(covered, text_of[hit], 1)
    np.maximum.at(longest, text_of[later], repeat[later])


def said_before(order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Per place of a suffix array: the symbols that its suffix shares with one that begins earlier, at most.

    ``order`` has the suffixes by rank, ``shared`` what each has in common with the one before it. The deepest interval that holds
    an earlier position runs to the nearest one on either side; both are found by halving steps over minima of windows.
    """
    n = len(order)
    first, least = [order], [shared]
    while (1 << len(first)) <= n:
        step = 1 << (len(first) - 1)
        first.append(np.minimum(first[-1][:-step], first[-1][step:]))
        least.append(np.minimum(least[-1][:-step], least[-1][step:]))
    best = np.zeros(n, np.int64)
    for left in (True, False):
        at, depth = np.arange(n), np.full(n, n, np.int64)
        for k in range(len(first) - 1, -1, -1):
            step = 1 << k
            begin = at - step if left else at + 1  # the window next to what has been passed
            inside = (begin >= 0) & (begin + step <= n)
            go = np.flatnonzero(inside)
            go = go[first[k][begin[go]] > order[go]]
            depth[go] = np.minimum(depth[go], least[k][begin[go] + 1 if left else begin[go]])
            at[go] += -step if left else step
        end = np.flatnonzero(at > 0) if left else np.flatnonzero(at + 1 < n)
        depth[end] = np.minimum(depth[end], shared[at[end]] if left else shared[at[end] + 1])
        best[end] = np.maximum(best[end], depth[end])
    return best


def repetition(df: DataFrame, text: str, keep: tuple[str, ...], min_words: int = MIN_WORDS) -> DataFrame:
    """One row per text: the columns ``keep``, then ``n_words``, ``repeat_words``, ``repeat_share`` and ``longest_repeat``.

    Words compare without case, spacing, punctuation or step numbers; the first time a phrase is said is not covered.
    Null and empty texts have 0 words and share 0.0; a text of any length is sorted whole. No shuffle takes place.
    """
    src = df.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count, covered, longest = measure(b.column(len(keep)), min_words)
            share = covered / np.maximum(count, 1)
            arrays = [*b.columns[: len(keep)], pa.array(count.astype(np.int64)), pa.array(covered), pa.array(share), pa.array(longest)]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "n_words", "repeat_words", "repeat_share", "longest_repeat"])

    return spread(src).mapInArrow(run, f"{schema}, n_words long, {SCHEMA}")


def repetitive(df: DataFrame, text: str, keep: tuple[str, ...], min_words: int = MIN_WORDS, min_share: float = MIN_SHARE, min_longest: int | None = None) -> DataFrame:
    """The rows of ``repetition`` beyond a limit: of the repeated share, or, where it is given, of the longest repeat in words."""
    beyond = F.col("repeat_share") >= min_share
    return repetition(df, text, keep, min_words).where(beyond if min_longest is None else beyond | (F.col("longest_repeat") >= min_longest))
