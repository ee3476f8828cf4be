"""Texts cut off by field limits or in transfer, and how often each source cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import pairs, terminal
from ledgerloom.operators.skew import lookup_join
from ledgerloom.session import durable


def ends(log: DataFrame, examples: DataFrame, source: tuple[str, ...] = pairs.SOURCE) -> DataFrame:
    """One row per output: ``row_id``, the source columns ``s0``.., ``state`` and whether it is ``truncated``.

    The structural check runs once over whole outputs. Rows it cannot settle are held against the baseline of their source
    (``terminal.with_baseline``); only rows whose end is in doubt meet their question, since a copy of the question is not
    a cut. Null and blank outputs are never cut; an empty log gives no rows.
    """
    names = tuple(f"s{i}" for i in range(len(source)))
    seen = durable(pairs.signals(log, source, ends_only=True), "ends")
    rows = terminal.with_baseline(seen, names).withColumn("cut", terminal.is_cut())
    doubt = F.col("cut") & F.col("short").isNotNull()
    asked = lookup_join(rows.where(doubt), pairs.questions(examples), "qid").withColumn("truncated", ~pairs.is_copy())
    settled = rows.where(~doubt).withColumn("truncated", F.col("cut"))
    wanted = ["row_id", *names, "state", "truncated"]
    return settled.select(*wanted).unionByName(asked.select(*wanted))


def truncated(log: DataFrame, examples: DataFrame, source: tuple[str, ...] = pairs.SOURCE) -> DataFrame:
    """The ``row_id`` of every output that stops before its end."""
    return ends(log, examples, source).where("truncated").select("row_id")


def cut_rates(log: DataFrame, examples: DataFrame, source: tuple[str, ...] = pairs.SOURCE) -> DataFrame:
    """Per source: ``n_rows``, ``n_cut`` and ``cut_rate`` (6 places); null sources form one group."""
    names = [F.col(f"s{i}").alias(c) for i, c in enumerate(source)]
    n, cut = F.count(F.lit(1)), F.count_if(F.col("truncated"))
    return ends(log, examples, source).groupBy(*names).agg(n.alias("n_rows"), cut.alias("n_cut"), F.round(cut / n, 6).alias("cut_rate"))
