"""Passages of held-out items inside training texts: spaced-seed hashing with verification around the hits."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import kernel
from ledgerloom.operators.skew import lookup_join
from ledgerloom.session import durable, spread

#: Word positions that count (1) or are ignored (0). Each mask takes six words; the gaps bridge single changed words.
MASKS = ("111111", "1110111", "1101111", "1111011", "11011011")
#: Least aligned words of a passage, and the largest share of words that may differ within it.
MIN_WORDS, MAX_DIFFER = 20, 0.18
#: Held-out words up to which the seeds go to every task as one index (some tens of MB); beyond, both sides' seeds are joined by a shuffle.
INDEX_WORDS = 500_000
#: Bits of the filter of seeds in the shuffled form, as a power of two: 16 for each seed, within these bounds (128 KB to 32 MB).
_FILTER_BITS = (20, 28)
#: Words kept on either side of a hit in the shuffled form, and rows of one seed from which its list of texts is split.
_KEPT, PART_ROWS = 80, 1_000_000
_TABLE_BITS = 22


@dataclass
class Sequence:
    """Words of a text as hashes, and which of them are figures."""

    words: np.ndarray
    figures: np.ndarray


@dataclass
class Index:
    """Hashes of all seeds of a block of items, sorted, and the words they came from."""

    items: np.ndarray
    texts: list[Sequence]
    hashes: np.ndarray
    item: np.ndarray
    at: np.ndarray
    present: np.ndarray
    flat: np.ndarray
    flat_start: np.ndarray


#: Words looked at on either side of a hit, and how far added or missing words may shift them, before it is aligned.
_AROUND, _SHIFT = 20, 3
#: Most words that are demanded near a hit: what the default asks for, which the window can hold to either side of a hit at the edge of a passage.
LEAST_NEAR = 0.75 * MIN_WORDS


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the masked words at every position where the mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(int(mask, 2) + 1), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            h = (h ^ words[k : n + k]) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(29)
    return h


def build_index(ids: list, texts: list[str | None], masks: tuple[str, ...] = MASKS) -> Index:
    """Seeds of every item; null and short items have none."""
    w = kernel.words(pa.array(texts, pa.large_string()))
    number = w.is_number()
    bounds = np.searchsorted(w.row, np.arange(len(texts) + 1))
    own = [Sequence(w.hash[a:b], number[a:b]) for a, b in zip(bounds, bounds[1:])]
    hs, its, ats = [], [], []
    for i, seq in enumerate(own):
        for mask in masks:
            h = seed_hashes(seq.words, mask)
            hs.append(h)
            its.append(np.full(len(h), i))
            ats.append(np.arange(len(h)))
    gap = np.zeros(_AROUND + 16, np.uint64)
    flat = np.concatenate([gap, *[x for seq in own for x in (seq.words, gap)]])
    flat_start = len(gap) + np.cumsum([0, *[len(seq.words) + len(gap) for seq in own]])
    h = np.concatenate([*hs, np.zeros(0, np.uint64)])
    order = np.argsort(h, kind="stable")
    present = np.zeros(1 << _TABLE_BITS, bool)
    present[h >> np.uint64(64 - _TABLE_BITS)] = True
    it, at = np.concatenate([*its, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*ats, np.zeros(0, np.int64)]).astype(np.int64)
    return Index(np.array(ids, np.int64), own, h[order], it[order], at[order], present, flat, flat_start)


def _extend(a: Sequence, b: Sequence, i: int, j: int, step: int) -> tuple[int, int, int, int]:
    """Follow two texts from ``(i, j)`` in one direction over single changed, added or missing words.

    Returns the aligned words and the differences at the best point (one up per word, four down per difference), and the
    places reached there. A difference is passed only if the words after it agree again; one figure in the place of
    another counts twice, since like wording with other figures is no leak.
    """
    same = diff = best_same = best_diff = score = best = 0
    bi, bj = i, j
    na, nb = len(a.words), len(b.words)
    aw, bw = a.words, b.words
    while 0 <= i < na and 0 <= j < nb:
        if aw[i] == bw[j]:
            i, j = i + step, j + step
            same += 1
            score += 1
            if score > best:
                best, best_same, best_diff, bi, bj = score, same, diff, i, j
            continue
        for di, dj in _STEPS:
            x, y = i + di * step, j + dj * step
            x2, y2 = x + step, y + step
            if 0 <= x < na and 0 <= y < nb and aw[x] == bw[y] and (not (0 <= x2 < na and 0 <= y2 < nb) or aw[x2] == bw[y2]):
                cost = max(di, dj) + sum(bool(a.figures[i + k * step] and b.figures[j + k * step]) for k in range(min(di, dj)))
                break
        else:
            break
        i, j = x, y
        diff += cost
        score -= 4 * cost
        if score < best - 16:
            break
    return best_same, best_diff, bi, bj


_STEPS = ((1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2))


def passages(item: Sequence, doc: Sequence, hits: list[tuple[int, int]], min_words: int, max_differ: float) -> bool:
    """True if some hit grows into a passage of ``min_words`` words that differs in at most ``max_differ`` of them.

    A changed word at either edge cannot be told from the surroundings, so up to two edge words count as given.
    """
    done: list[tuple[int, int, int, int]] = []
    for i, j in hits:
        if any(p <= i < q and r <= j < s for p, q, r, s in done):
            continue
        right, left = _extend(item, doc, i, j, 1), _extend(item, doc, i - 1, j - 1, -1)
        same, diff, span = right[0] + left[0], right[1] + left[1], right[2] - left[2] - 1
        if span >= min_words - 2 and same >= 0.75 * min_words and diff <= max_differ * (same + diff):
            return True
        done.append((left[2] + 1, right[2], left[3] + 1, right[3]))
    return False


def _promising(index: Index, words: np.ndarray, item: np.ndarray, at: np.ndarray, doc_at: np.ndarray, least: float) -> np.ndarray:
    """Hits with at least ``least`` words of the item's surroundings found near the same place of the text.

    Every passage that alignment could accept meets this: it only spares the others the word-by-word pass.
    """
    keep = np.zeros(len(item), bool)
    for lo in range(0, len(item), 100_000):
        part = slice(lo, lo + 100_000)
        base, place = index.flat_start[item[part]] + at[part], doc_at[part]
        count = np.zeros(len(base), np.int16)
        for o in range(-_AROUND, _AROUND + 7):
            want = index.flat[base + o]
            seen = np.zeros(len(base), bool)
            for s in range(-_SHIFT, _SHIFT + 1):
                seen |= words[np.clip(place + (o + s), 0, len(words) - 1)] == want
            count += seen & (want != 0)
        keep[part] = count >= least
    return keep


def probe(index: Index, texts: pa.Array, masks: tuple[str, ...], min_words: int, max_differ: float) -> tuple[list[int], list[int]]:
    """Text numbers and item numbers of all verified leaks of a batch."""
    w = kernel.words(texts)
    text_of, item_of, doc_at, item_at = [], [], [], []
    for mask in masks:
        h = seed_hashes(w.hash, mask)
        if not len(h):
            continue
        cand = np.flatnonzero(index.present[h >> np.uint64(64 - _TABLE_BITS)])
        cand = cand[w.row[cand] == w.row[cand + len(mask) - 1]]
        lo = np.searchsorted(index.hashes, h[cand], "left")
        n = np.searchsorted(index.hashes, h[cand], "right") - lo
        cand, lo, n = cand[n > 0], lo[n > 0], n[n > 0]
        if not len(cand):
            continue
        entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        text_of.append(np.repeat(w.row[cand], n))
        doc_at.append(np.repeat(cand, n))
        item_of.append(index.item[entry])
        item_at.append(index.at[entry])
    if not text_of:
        return [], []
    t, i, d, a = map(np.concatenate, (text_of, item_of, doc_at, item_at))
    good = _promising(index, w.hash, i, a, d, min(0.75 * min_words, LEAST_NEAR))
    t, i, d, a = t[good], i[good], d[good], a[good]
    if not len(t):
        return [], []
    order = np.lexsort((d, i, t))
    t, i, d, a = t[order], i[order], d[order], a[order]
    starts = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (i[1:] != i[:-1])]))
    ends = np.append(starts[1:], len(t))
    first = np.searchsorted(w.row, np.arange(len(texts) + 1))
    number = w.is_number()
    out_t, out_i = [], []
    for s, e in zip(starts.tolist(), ends.tolist()):
        k = int(t[s])
        part = slice(first[k], first[k + 1])
        if passages(index.texts[int(i[s])], Sequence(w.hash[part], number[part]), list(zip(a[s:e].tolist(), (d[s:e] - first[k]).tolist())), min_words, max_differ):
            out_t.append(k)
            out_i.append(int(i[s]))
    return out_t, out_i


_INDEX: dict[str, Index] = {}


def _kept_index(key: str, shared, masks: tuple[str, ...]) -> Index:
    """The index of the held-out side, built once per worker; only the last one is kept."""
    if key not in _INDEX:
        _INDEX.clear()
        _INDEX[key] = build_index(*shared.value, masks)
    return _INDEX[key]


def _by_index(docs: DataFrame, items: DataFrame, masks: tuple[str, ...], min_words: int, max_differ: float) -> DataFrame:
    """The seed join with the held-out side in every task: nothing of the texts is shuffled."""
    rows = items.orderBy("item_id", "text").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((rows["item_id"].to_pylist(), rows["text"].to_pylist()))

    def run(batches: Iterator[pa.RecordBatch], key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
        index = _kept_index(key, shared, masks)
        for b in batches:
            t, i = probe(index, b.column(1), masks, min_words, max_differ)
            got = {"doc_id": pc.take(b.column(0), pa.array(t, pa.int64())), "item_id": pa.array(index.items[i] if i else [], pa.int64())}
            yield pa.RecordBatch.from_arrays(list(got.values()), list(got))

    return spread(docs).mapInArrow(run, "doc_id long, item_id long")


_PIECE = "key long, id long, words binary, figures binary, seeds array<bigint>, places array<int>"


def _pieces(df: DataFrame, masks: tuple[str, ...], bits: tuple[int, np.ndarray] | None = None) -> DataFrame:
    """Texts with their seeds and the place of each; with a filter only its hits, in pieces of the text that hold their surroundings.

    ``key`` is a hash of id and words, so equal pieces of one id are one.
    """
    shared = None if bits is None else df.sparkSession.sparkContext.broadcast(bits)
    names = [c.split()[0] for c in _PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = kernel.words(b.column(1))
            number = w.is_number()
            ids = b.column(0).to_pylist()
            seeds, places = [], []
            for mask in masks:
                h = seed_hashes(w.hash, mask)
                at = np.flatnonzero(w.row[: len(h)] == w.row[len(mask) - 1 :]) if len(h) else np.zeros(0, np.int64)
                if shared is not None:
                    at = at[_may_hold(shared.value, h[at])]
                seeds.append(h[at])
                places.append(at)
            seed, place = np.concatenate(seeds), np.concatenate(places)
            order = np.argsort(place, kind="stable")
            seed, place = seed[order], place[order]
            row = w.row[place]
            bounds = np.searchsorted(w.row, np.arange(b.num_rows + 1))
            parted = (np.diff(row) != 0) | (np.diff(place) > 2 * _KEPT if shared is not None else False)
            starts = np.concatenate([[0], np.flatnonzero(parted) + 1]).astype(np.int64) if len(place) else np.zeros(0, np.int64)
            out: list[list] = [[] for _ in names]
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(place)]):
                r = int(row[lo])
                first, last = (int(bounds[r]), int(bounds[r + 1])) if shared is None else (max(int(bounds[r]), int(place[lo]) - _KEPT), min(int(bounds[r + 1]), int(place[hi - 1]) + _KEPT))
                own = w.hash[first:last]
                key = kernel.mix(np.bitwise_xor.reduce(kernel.mix(own + kernel.mix(np.arange(1, len(own) + 1).astype(np.uint64)))) + np.array([ids[r] or 0], np.int64).view(np.uint64))
                for c, v in zip(out, (key.view(np.int64)[0], ids[r], own.tobytes(), number[first:last].tobytes(), seed[lo:hi].view(np.int64), (place[lo:hi] - first).astype(np.int32))):
                    c.append(v)
            types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    return spread(df).mapInArrow(run, _PIECE)


def _may_hold(bits: tuple[int, np.ndarray], h: np.ndarray) -> np.ndarray:
    """Whether the filter has each hash."""
    at = h >> np.uint64(64 - bits[0])
    return (bits[1][(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def _filter(seeds: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """A bit per hash prefix that some seed has, put together by the executors; only the bits, of bounded number, reach the driver."""
    power = min(max(_FILTER_BITS[0], int(n * 16).bit_length()), _FILTER_BITS[1])
    at = F.shiftrightunsigned("seed", 64 - power)
    rows = seeds.groupBy(F.shiftrightunsigned(at, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(seed, %d) & 63 as int))" % (64 - power))).alias("b")).toArrow()
    bits = np.zeros(1 << (power - 6), np.uint64)
    bits[rows["w"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    return power, bits


def _by_shuffle(docs: DataFrame, items: DataFrame, masks: tuple[str, ...], min_words: int, max_differ: float) -> DataFrame:
    """The seed join by a shuffle on the seed: of the texts only pieces around seeds that the held-out side has are kept and moved.

    A seed that very many texts share is split by text, and the held-out side meets each part. The words of an item that very many
    texts hold are joined apart (``lookup_join``). The corpus is read once; nothing of either side reaches the driver but the filter.
    """
    held = durable(_pieces(items, masks).dropDuplicates(["key"]), "items")
    both = ("key", F.explode(F.arrays_zip("seeds", "places")).alias("s"))
    theirs = held.select(*both).select(F.col("key").alias("item"), F.col("s.seeds").alias("seed"), F.col("s.places").alias("i"))
    pieces = durable(_pieces(docs, masks, _filter(theirs, theirs.count())), "pieces")
    ours = pieces.select(*both).select("key", F.col("s.seeds").alias("seed"), F.col("s.places").alias("j"))
    parts = ours.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART_ROWS).select("seed", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts"))
    ours, theirs = (x.join(parts, "seed", "left").withColumn("parts", F.coalesce("parts", F.lit(1))) for x in (ours, theirs))
    ours = ours.withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int")).drop("parts")
    theirs = theirs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    hits = ours.join(theirs, ["seed", "part"]).groupBy("key", "item").agg(F.collect_set(F.struct("i", "j")).alias("hits"))
    hits = hits.join(pieces.dropDuplicates(["key"]).select("key", F.col("id").alias("doc_id"), "words", "figures"), "key")
    hits = lookup_join(durable(hits.drop("key"), "hits"), held.select(F.col("key").alias("item"), F.col("id").alias("item_id"), F.col("words").alias("item_words"), F.col("figures").alias("item_figures")), "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for hit, words, figures, item_words, item_figures in zip(*(b.column(k).to_pylist() for k in range(2, 7))):
                item, doc = (Sequence(np.frombuffer(w, np.uint64), np.frombuffer(f, bool)) for w, f in ((item_words, item_figures), (words, figures)))
                good.append(passages(item, doc, sorted((x["i"], x["j"]) for x in hit), min_words, max_differ))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["doc_id", "item_id"]).filter(pa.array(good, pa.bool_()))

    return hits.select("doc_id", "item_id", "hits", "words", "figures", "item_words", "item_figures").mapInArrow(run, "doc_id long, item_id long")


def leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    masks: tuple[str, ...] = MASKS,
    min_words: int = MIN_WORDS,
    max_differ: float = MAX_DIFFER,
    index_words: int = INDEX_WORDS,
) -> DataFrame:
    """One row ``doc_id, item_id`` per text that holds a passage of at least ``min_words`` words of an item.

    Spaced seeds of texts and items are joined, and around each hit the words are aligned over single changed, added or missing
    words and the passage counted. Items of up to ``index_words`` words in all (counted first) go to every task, so the corpus is not
    shuffled; more are joined by a shuffle of the seeds, where a passage is followed up to 80 words to either side of the hits.
    Either way the corpus is read once and whole. Case, spacing, punctuation, line breaks and escape residue do not matter. Items
    without id, and null, empty and short texts have no rows; documents without id come out with a null; repeated items (or ids)
    give one row per document and id.
    """
    if min_words < 8:
        raise ValueError("min_words must be at least 8, the longest mask")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text"))
    held = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    n_words = held.agg(F.sum(F.length(F.regexp_replace("text", r"[^\s\p{IsHan}\p{IsHiragana}\p{IsKatakana}]+", "x")))).first()[0] or 0
    form = _by_index if n_words <= 2 * index_words else _by_shuffle
    return form(texts, held, masks, min_words, max_differ).distinct()
