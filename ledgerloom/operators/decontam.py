"""Overlap of training text with evaluation text by word n-gram containment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import shingle_hashes, tokens
from ledgerloom.session import durable

#: Fixed values of the method: tokens per shingle, and the containment from which a row is dropped.
N_GRAM, THRESHOLD = 8, 0.5


def corpus(texts: DataFrame, columns: tuple[str, ...], n: int = N_GRAM) -> DataFrame:
    """The distinct shingles of several text columns, as hashes in column ``gram``."""
    each = [texts.select(F.explode(shingle_hashes(tokens(F.col(c)), n)).alias("gram")) for c in columns]
    return reduce(DataFrame.unionByName, each).distinct()


def containment(rows: DataFrame, key: str, columns: tuple[str, ...], grams: DataFrame, n: int = N_GRAM) -> DataFrame:
    """``key`` (unique) and, for each text column, ``<column>_overlap``: the share of its distinct shingles that the corpus has.

    Texts of fewer than ``n`` tokens, and null ones, have 0.0. The corpus is written once, so its size is
    known to the optimiser, which sends it to the tasks below its own threshold and else shuffles both sides; there shingles that
    very many rows share are split by AQE's skew join, the corpus side being distinct.
    """
    grams = durable(grams.select("gram", F.lit(1).alias("hit")), "grams")
    parts = [
        rows.select(F.col(key), F.lit(k).alias("field"), F.explode(shingle_hashes(tokens(F.col(c)), n)).alias("gram"))
        for k, c in enumerate(columns)
    ]
    met = reduce(DataFrame.unionByName, parts).join(grams, "gram", "left")
    shares = []
    for k, c in enumerate(columns):
        own = F.col("field") == k
        shares.append(F.try_divide(F.count_if(own & F.col("hit").isNotNull()), F.count_if(own)).alias(f"{c}_overlap"))
    found = met.groupBy(key).agg(*shares)
    zero = [F.coalesce(F.col(f"{c}_overlap"), F.lit(0.0)).alias(f"{c}_overlap") for c in columns]
    return rows.select(key).join(found, key, "left").select(key, *zero)


def decontaminate(train: DataFrame, held_out: DataFrame, key: str = "id", n: int = N_GRAM) -> DataFrame:
    """Containment of question and context of every training row in the evaluation rows' questions and contexts."""
    columns = ("question", "context")
    return containment(train, key, columns, corpus(held_out, columns, n), n)


def kept(train: DataFrame, scores: DataFrame, key: str = "id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose question overlap is below ``threshold``."""
    return train.join(scores.where(F.col("question_overlap") < threshold).select(key), key, "left_semi")


def report(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row: rows, dropped and kept rows, and interpolated quantiles (4 places) of both overlaps.

    The quantiles are exact: one task holds the distinct shares with their counts. A share is a ratio of two shingle counts of one
    text, so there are as many as such ratios, not as rows.
    """
    at = [0.5, 0.9, 0.95, 0.99]
    dropped = F.count_if(F.col("question_overlap") >= threshold)
    base = scores.agg(F.count(F.lit(1)).alias("n_rows"), dropped.alias("n_dropped"), (F.count(F.lit(1)) - dropped).alias("n_kept"), *[F.percentile(f"{c}_overlap", F.array(*map(F.lit, at))).alias(c) for c in ("question", "context")])
    cells = [F.round(F.col(c)[k], 4).alias(f"{c}_p{int(q * 100)}") for c in ("question", "context") for k, q in enumerate(at)]
    return base.select("n_rows", "n_dropped", "n_kept", *cells)


def worst(scores: DataFrame, n: int = 5, key: str = "id") -> DataFrame:
    """The ``n`` rows of greatest question overlap, ties by key."""
    return scores.orderBy(F.desc("question_overlap"), key).limit(n)
