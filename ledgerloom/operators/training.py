"""Training targets: executing programs, dispositions of rows, records, length filters."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import program as prog
from ledgerloom.functions.prompts import messages, render_prompt
from ledgerloom.functions.text import estimated_tokens

#: Outcomes of a row, in the order in which they are tried.
TABLE_OP, PARSE_ERROR, MISMATCH, KEPT = "table_op", "parse_error", "mismatch", "kept"


def plain_double(gold: Column) -> Column:
    """A gold as a plain number; a percentage or any other format is none."""
    return F.when(F.trim(gold).rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), F.trim(gold).try_cast("double"))


def dispositions(examples: DataFrame) -> DataFrame:
    """Adds ``run`` (the executed program), ``gold_number``, and ``disposition``; every row has exactly one.

    Programs with table operations are set aside before they are run; errors, golds that are no plain number and results
    beyond the tolerance of the gold follow. Null programs count as empty.
    """
    table_op = prog.uses_table_op(F.col("program"))
    rows = examples.withColumn("run", F.when(~table_op, prog.execute(F.col("program")))).withColumn("gold_number", plain_double(F.col("gold")))
    close = F.abs(F.col("run.value") - F.col("gold_number")) <= prog.target_tolerance(F.col("gold_number"))
    outcome = F.when(table_op, TABLE_OP).when(F.col("run.error").isNotNull() | F.col("gold_number").isNull(), PARSE_ERROR).when(~close, MISMATCH).otherwise(KEPT)
    return rows.withColumn("disposition", outcome)


def disposition_report(rows: DataFrame) -> DataFrame:
    """Rows per disposition, with their share (4 places)."""
    counts = rows.groupBy("disposition").agg(F.count(F.lit(1)).alias("n_rows"))
    total = rows.count()
    return counts.withColumn("share", F.bround(F.col("n_rows") / F.lit(max(total, 1)), 4))


def records(rows: DataFrame, arm: str = "cot") -> DataFrame:
    """Training records ``id, messages`` of the kept rows: the prompt of ``arm``, and steps, program and answer as the reply."""
    kept = rows.where(F.col("disposition") == KEPT)
    target = prog.target_text(F.col("run.sentences"), F.col("program"), F.col("gold"))
    return kept.select("id", messages(render_prompt(arm, F.col("question"), F.col("context")), target).alias("messages"))


def op_histogram(rows: DataFrame, program: str = "program") -> DataFrame:
    """Calls (not rows) per operator."""
    return rows.select(F.explode(prog.calls(F.col(program))).alias("c")).groupBy(F.col("c.op").alias("op")).agg(F.count(F.lit(1)).alias("n_calls"))


def record_length(msgs: Column, per_token: float = 3.6) -> Column:
    """Estimated tokens of all messages of a record."""
    return estimated_tokens(F.concat_ws("\n", F.transform(msgs, lambda m: m["content"])), per_token)


def token_lengths(records_: DataFrame, count: Callable[[list[str]], list[int]], per_batch: int = 256) -> DataFrame:
    """Adds ``n_tokens`` by a tokenizer of the caller's: ``count`` takes texts and gives their lengths. The estimate needs no Python; this is the exact way."""
    text = F.concat_ws("\n", F.transform("messages", lambda m: m["content"]))

    @F.pandas_udf("long")
    def lengths(texts: pd.Series) -> pd.Series:
        out: list[int] = []
        for lo in range(0, len(texts), per_batch):
            out += count(texts.iloc[lo : lo + per_batch].tolist())
        return pd.Series(out, dtype="int64")

    return records_.withColumn("n_tokens", lengths(text))


def within_length(records_: DataFrame, most: int = 3072, per_token: float = 3.6) -> DataFrame:
    """The records of at most ``most`` tokens; longer ones are left out whole, never cut."""
    return records_.where(record_length(F.col("messages"), per_token) <= most)


def beyond_length(records_: DataFrame, most: int = 3072, per_token: float = 3.6) -> DataFrame:
    """Id and length of the records that are left out."""
    n = record_length(F.col("messages"), per_token)
    return records_.select("id", n.alias("n_tokens")).where(F.col("n_tokens") > most)


def length_report(records_: DataFrame, most: int = 3072, per_token: float = 3.6) -> DataFrame:
    """One row: records, kept, dropped, and greatest length."""
    n = record_length(F.col("messages"), per_token)
    sized = records_.select(n.alias("n"))
    return sized.agg(F.count(F.lit(1)).alias("n_records"), F.count_if(F.col("n") <= most).alias("n_kept"), F.count_if(F.col("n") > most).alias("n_dropped"), F.max("n").alias("longest"))


def index_percentiles(df: DataFrame, value: Column, at: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """One row per wanted share: the sorted value at ``min(int(n * share), n - 1)``, without interpolation.

    Values are counted first, so what is ranked is one row per distinct value, not per row; it is for values such as lengths.
    """
    counts = df.select(value.alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    ordered = F.sort_array(F.collect_list(F.struct("v", "c")))
    one = counts.agg(ordered.alias("h"), F.sum("c").alias("n"))
    places = F.explode(F.array(*[F.struct(F.lit(p).alias("share"), F.least(F.floor(F.col("n") * p), F.col("n") - 1).alias("k")) for p in at]))
    rows = one.select("h", places.alias("p"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast(counts.schema["v"].dataType.simpleString()).alias("v"))
    walk = F.aggregate("h", start, lambda a, x: F.struct((a["seen"] + x["c"]).alias("seen"), F.coalesce(a["v"], F.when(a["seen"] + x["c"] > F.col("p.k"), x["v"])).alias("v")))
    return rows.select(F.col("p.share").alias("share"), walk["v"].alias("value"))
