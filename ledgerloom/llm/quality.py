"""Per-document text statistics, and their robust distance from natural prose of the same language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import prose
from ledgerloom.llm.prose import STATS
from ledgerloom.session import durable, spread

KINDS = ("table", "list", "junk")
#: Least standard deviation of each statistic, so that a statistic that never varies in prose cannot blow up the distance.
FLOOR = np.array([0.02, 0.05, 0.06, 0.4, 0.4, 1.0, 0.03, 0.05, 0.05, 0.1, 0.01, 0.02, 0.03, 0.03, 0.03, 0.005, 0.01, 0.02])
#: Which kind each statistic speaks for when it is far from prose, and in which direction.
SPEAKS = {
    "table": {"digit_ratio": 1, "figure_tokens": 1, "separators": 1},
    "list": {"marked_lines": 1, "leaders": 1, "line_chars": -1, "ended_lines": -1},
    "junk": {
        "vowelless_words": 1,
        "single_letters": 1,
        "long_tokens": 1,
        "mixed_tokens": 1,
        "signs_in_words": 1,
        "case_switches": 1,
        "markup": 1,
        "symbol_ratio": 1,
        "mean_word_len": 1,
        "common_words": -1,
        "stop_rate": -1,
    },
}
#: Squared distance beyond which a block is no prose (the 0.95 quantile of chi-square for as many statistics), and the share of characters.
LIMIT, HALF = 28.87, 0.5
#: Weight of the pooled prose in the model of one language, as a share of all text: rare languages lean on it at every size.
PRIOR = 0.01
#: Greatest value and number of the bins from which the first quartiles are read.
_TOP, _BINS = np.array([1, 1, 1, 30, 1, 6, 1, 1, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1.0]), 512
#: What says nothing in scripts that have no dictionary here, or no spaces between words.
_BY_WORDS = np.array([s in ("common_words", "mean_word_len", "stop_rate", "line_chars", "figure_tokens", "mixed_tokens", "single_letters", "long_tokens", "separators", "ended_lines", "digit_ratio") for s in STATS])
_P = len(STATS)
_DTYPE = np.float16


def text_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text with at least one sign: ``doc_id``, ``lang_found``, the plain counts, and size and statistics of its blocks; no shuffle."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", "lang_found", *[f"n_{c}" for c in prose.PLAIN], "sizes", "stats"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars + len(texts[hi]) <= prose.CHUNK_CHARS):
                    chars += len(texts[hi])
                    hi += 1
                got = prose.blocks(texts[lo:hi]) if len(texts[lo]) <= prose.CHUNK_CHARS else prose.blocks_of_long(texts[lo])
                ends = np.searchsorted(got.text, np.arange(hi - lo + 1))
                use = np.flatnonzero(np.diff(ends))
                stats, sizes = got.stats.astype(_DTYPE), got.chars.astype(np.int32)
                cols = [
                    b.column(0).slice(lo, hi - lo).take(pa.array(use)),
                    pa.array([got.lang[k] for k in use], pa.string()),
                    *[pa.array(got.plain[use, k].astype(np.int64)) for k in range(len(prose.PLAIN))],
                    pa.array([sizes[ends[k] : ends[k + 1]].tobytes() for k in use], pa.binary()),
                    pa.array([stats[ends[k] : ends[k + 1]].tobytes() for k in use], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names)
                lo = hi

    counts = "".join(f"n_{c} long, " for c in prose.PLAIN)
    return spread(src).mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, lang_found string, {counts}sizes binary, stats binary")


def _unpack(sizes: pa.Array, stats: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, characters and statistics of all blocks of a batch."""
    chars = np.frombuffer(b"".join(sizes.to_pylist()), np.int32).astype(float)
    row = np.repeat(np.arange(len(sizes)), [len(x) // 4 for x in sizes.to_pylist()])
    return row, chars, np.frombuffer(b"".join(stats.to_pylist()), _DTYPE).astype(float).reshape(-1, _P)


def _by_language(blocks: DataFrame, size: int, add) -> dict[str, np.ndarray]:
    """Sums over all blocks per language (``size`` numbers each), added up per task and then by position; there are as many languages as dictionaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            row, chars, x = _unpack(b.column(1), b.column(2))
            lang = np.array(b.column(0).to_pylist(), object)
            for one in sorted(set(lang.tolist())):
                at = lang[row] == one
                sums[one] = sums.get(one, np.zeros(size)) + add(one, x[at], chars[at])
        for one, values in sums.items():
            at = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays([pa.array([one] * len(at), pa.string()), pa.array(at), pa.array(values[at])], ["lang", "at", "v"])

    rows = blocks.select("lang_found", "sizes", "stats").mapInArrow(run, "lang string, at long, v double").groupBy("lang", "at").agg(F.sum("v").alias("v")).toArrow()
    out: dict[str, np.ndarray] = {}
    for lang, at, v in zip(*(rows[c].to_pylist() for c in ("lang", "at", "v"))):
        out.setdefault(lang, np.zeros(size))[at] = v
    return out


def _histogram(_: str, x: np.ndarray, chars: np.ndarray) -> np.ndarray:
    bins = np.minimum((x / _TOP * _BINS).astype(np.int64), _BINS - 1) + np.arange(_P) * _BINS
    return np.bincount(bins.ravel(), np.repeat(chars, _P), minlength=_P * _BINS)


def _start(found: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Medians, and the spread of the quartiles on the diagonal, from histograms."""
    h = found.reshape(_P, _BINS)
    run = np.cumsum(h, 1)
    low, mid, high = (np.array([np.searchsorted(r, q * r[-1]) + 0.5 for r in run]) / _BINS * _TOP for q in (0.25, 0.5, 0.75))
    return float(run[0, -1]), mid, np.diag(((high - low) / 1.349) ** 2)


def _moments(found: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    n, sums, cross = found[0], found[1 : _P + 1], found[_P + 1 :].reshape(_P, _P)
    mean = sums / n
    return n, mean, cross / n - np.outer(mean, mean)


Models = dict[str, tuple[np.ndarray, np.ndarray]]


def _models(found: dict[str, tuple[float, np.ndarray, np.ndarray]]) -> Models:
    """Mean and inverse covariance per language, drawn to the pooled prose by ``PRIOR`` of all text; ``""`` is the pooled model."""
    total = sum(n for n, _, _ in found.values())
    if not total:
        return {"": (np.zeros(_P), np.diag(1 / FLOOR**2))}
    mean = sum(n * m for n, m, _ in found.values()) / total
    cov = sum(n * (c + np.outer(m - mean, m - mean)) for n, m, c in found.values()) / total
    models = {"": (mean, np.linalg.inv(cov + np.diag(FLOOR**2)))}
    for lang, (n, m, c) in found.items():
        w = n / (n + PRIOR * total)
        models[lang] = (w * m + (1 - w) * mean, np.linalg.inv(w * c + (1 - w) * cov + np.diag(FLOOR**2)))
    return models


def _parts(models: Models, lang: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences from the prose of the language, and each statistic's part of the squared distance; the parts sum to it."""
    mean, inv = models.get(lang, models[""])
    z = x - mean
    if lang == "script":
        z[:, _BY_WORDS] = 0.0
    return z, z * (z @ inv)


def fit(blocks: DataFrame, rounds: int = 3, limit: float = LIMIT) -> Models:
    """Robust mean and covariance of prose per language, over all blocks weighed by their characters.

    It starts from medians and quartiles, which hold while most text of a language is prose, then ``rounds`` times leaves out the
    blocks beyond ``limit`` and fits again. No text is told to be prose beforehand, and no sample is taken. Text whose language
    is not found is held against the pooled prose, and does not count towards it.
    """
    known = blocks.where("lang_found != 'other' and lang_found != 'script'")
    models = _models({lang: _start(h) for lang, h in _by_language(known, _P * _BINS, _histogram).items()})
    for _ in range(rounds):

        def add(lang: str, x: np.ndarray, chars: np.ndarray, models: Models = models) -> np.ndarray:
            w = chars * (_parts(models, lang, x)[1].sum(1) <= limit)
            return np.concatenate([[w.sum()], w @ x, ((x * w[:, None]).T @ x).ravel()])

        found = {lang: _moments(v) for lang, v in _by_language(known, 1 + _P + _P * _P, add).items() if v[0] > 0}
        models = _models(found) if found else models
    return models


def distances(blocks: DataFrame, models: Models, limit: float = LIMIT) -> DataFrame:
    """Per text: plain statistics, the mean of each block statistic, ``outside`` (share of characters in blocks beyond ``limit``), ``distance``, its parts, ``kind``.

    ``distance`` and the parts are means over the blocks by characters, so the parts sum to the distance. ``kind`` is what the
    statistics speak for that contribute most in the blocks beyond ``limit``; null where there are none.
    """
    counts = [f"n_{c}" for c in prose.PLAIN]
    speaks = np.zeros((len(KINDS), _P))
    for k, kind in enumerate(KINDS):
        for s, sign in SPEAKS[kind].items():
            speaks[k, STATS.index(s)] = sign

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            row, chars, x = _unpack(b.column(2), b.column(3))
            lang = np.array(b.column(1).to_pylist(), object)
            z, parts = np.zeros_like(x), np.zeros_like(x)
            for one in set(lang.tolist()):
                at = lang[row] == one
                z[at], parts[at] = _parts(models, one, x[at])
            far = parts.sum(1) > limit
            total = np.maximum(np.bincount(row, chars, minlength=n), 1)
            said = np.stack([np.bincount(row, chars * far * (np.maximum(parts, 0) * (z * s > 0)).sum(1), minlength=n) for s in speaks], 1)
            kind = [KINDS[k] if v[k] > 0 else None for k, v in zip(said.argmax(1).tolist(), said)]

            def mean(v: np.ndarray) -> pa.Array:
                return pa.array(np.bincount(row, chars * v, minlength=n) / total)

            counted = {c: b.column(4 + k).to_numpy(zero_copy_only=False) for k, c in enumerate(counts)}
            cols = {
                "doc_id": b.column(0),
                "lang_found": b.column(1),
                "n_words": b.column(4),
                "mean_word_len": pa.array(counted["n_letters"] / np.maximum(counted["n_words"], 1)),
                "symbol_ratio": pa.array(counted["n_symbols"] / np.maximum(counted["n_dense"], 1)),
                "ended_lines": pa.array(counted["n_ended"] / np.maximum(counted["n_lines"], 1)),
                "common_words": pa.array(counted["n_common"] / np.maximum(counted["n_words"], 1)),
                "outside": mean(far.astype(float)),
                "distance": mean(parts.sum(1)),
                "kind": pa.array(kind, pa.string()),
                **{f"part_{s}": mean(parts[:, k]) for k, s in enumerate(STATS)},
            }
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    schema = f"doc_id {blocks.schema['doc_id'].dataType.simpleString()}, lang_found string, n_words long, mean_word_len double, symbol_ratio double, ended_lines double, common_words double, outside double, distance double, kind string, "
    return blocks.select("doc_id", "lang_found", "sizes", "stats", *counts).mapInArrow(run, schema + ", ".join(f"part_{s} double" for s in STATS))


def prose_distance(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = 3, limit: float = LIMIT) -> DataFrame:
    """Every text with its statistics, its robust Mahalanobis distance from prose of its language, and each statistic's part of that.

    Statistics are taken per block of about ``prose.BLOCK_CHARS`` characters, so that a text half of which is a table is told from
    prose with many figures. They are counted in one pass over the texts and written once, in a few percent of the input; the
    fit (``fit``) is an aggregate per round over that. Null, empty and blank texts have no row; texts of any length are taken
    whole; repeated rows count each; without any text there are no rows.
    """
    blocks = durable(text_blocks(docs, doc_id, text), "text-blocks")
    return distances(blocks, fit(blocks, rounds, limit), limit)


def not_prose(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: float = LIMIT, half: float = HALF) -> DataFrame:
    """``doc_id, kind, distance`` of the texts more than ``half`` of whose characters lie beyond ``limit`` from prose."""
    return prose_distance(docs, doc_id, text, limit=limit).where((F.col("outside") > half) & F.col("kind").isNotNull()).select("doc_id", "kind", "distance")
