"""The append-only run log: resuming, first write wins, running totals, manifests, cost, and the completion hook."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerloom.functions.text import estimated_tokens
from ledgerloom.operators.delivery import ANSWER_KEY, normal_key

#: Rows of one range of a running total.
RANGE_ROWS = 1_000_000
#: Fixed values of the price list (USD per million tokens), and of the retry rule.
PRICE_IN, PRICE_OUT, MAX_OUT = 1.0, 5.0, 700
RETRY_STATUS = (429, 500, 502, 503, 529)


def normalized(log: DataFrame) -> DataFrame:
    """The log with its keys (those of ``ANSWER_KEY`` that it has) in normal form: trimmed, lower case, ``model`` in file-name form."""
    return log.withColumns({k: normal_key(k) for k in ANSWER_KEY if k in log.columns})


def first_writes(log: DataFrame, keys: tuple[str, ...] = ("model", "arm", "eval_set", "id"), order: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """The first row of each key in write order. An aggregate, so that copies are combined before the shuffle."""
    first = log.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_f")).select(*[F.col(f"_f.{o}").alias(o) for o in order])
    return log.join(first, list(order), "left_semi")


def todo(examples: DataFrame, log: DataFrame, key: str = "id") -> DataFrame:
    """Examples that the log has no answer for; ids compare as text."""
    done = log.select(F.col(key).cast("string").alias("_done")).where("_done is not null").distinct()
    return examples.join(done, F.col(key).cast("string") == F.col("_done"), "left_anti")


def running(log: DataFrame, order: str, group: tuple[str, ...], buckets: int | None = None) -> DataFrame:
    """Adds ``n_so_far``, ``acc_so_far`` and ``cost_so_far`` in the order of a unique number within each group.

    A running total over a whole group would sort it in one task. Here the order is cut into ranges at approximate quantiles;
    totals run within a range, and the few totals of the ranges before are added. So a group of any size is spread; a range holds
    about ``RANGE_ROWS`` rows (200 ranges at least). Rows with a null order come first, as in a plain ascending sort.
    """
    buckets = buckets or max(200, -(-log.count() // RANGE_ROWS))
    cuts = log.agg(F.percentile_approx(F.col(order), [k / buckets for k in range(1, buckets)]).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.coalesce(F.col(order), F.lit(cuts[0] - 1)))) if cuts else F.lit(0)
    one, cost = F.coalesce(F.col("correct").cast("int"), F.lit(0)), F.coalesce("cost_usd", F.lit(0.0))
    rows = log.withColumn("_b", bucket).withColumns({f"_g{i}": F.to_json(F.struct(F.col(g).alias("v"))) for i, g in enumerate(group)})
    keys = [f"_g{i}" for i in range(len(group))]
    inside = W.partitionBy(*keys, "_b").orderBy(F.asc_nulls_first(order)).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"), F.sum(one).alias("_k"), F.sum(cost).alias("_c"))
    offsets = totals.select(*keys, "_b", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("_n", "_k", "_c")])
    got = rows.withColumns({"_n": F.count(F.lit(1)).over(inside), "_k": F.sum(one).over(inside), "_c": F.sum(cost).over(inside)}).join(offsets, [*keys, "_b"])
    n = F.col("_n") + F.col("_n0")
    return got.select(*log.columns, n.alias("n_so_far"), ((F.col("_k") + F.col("_k0")) / n).alias("acc_so_far"), (F.col("_c") + F.col("_c0")).alias("cost_so_far"))


def token_cost(tokens_in: Column, tokens_out: Column, price_in: float = PRICE_IN, price_out: float = PRICE_OUT) -> Column:
    """USD of a call."""
    return tokens_in / F.lit(1e6) * price_in + tokens_out / F.lit(1e6) * price_out


def cost_estimate(prompts: DataFrame, prompt: str, group: str, max_out: int = MAX_OUT) -> DataFrame:
    """Per group and in total (null group): rows, estimated prompt tokens, and the cost if every answer has ``max_out`` tokens."""
    sized = prompts.select(group, estimated_tokens(F.col(prompt)).alias("t"))
    got = sized.rollup(group).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("t").alias("tokens_in"))
    return got.withColumn("worst_cost", F.round(token_cost(F.col("tokens_in"), F.col("n_rows") * max_out), 6))


def manifest(log: DataFrame) -> DataFrame:
    """Progress per model and evaluation set, derived from the log rather than kept beside it."""
    return log.groupBy("model", "eval_set").agg(
        F.countDistinct("id").alias("n_done"), F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 6).alias("cost_usd"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


class CallError(Exception):
    """A failed call, with the status that the service gave (None where the connection failed)."""

    def __init__(self, message: str = "", status: int | None = None):
        super().__init__(message)
        self.status = status


class RetryableError(CallError):
    """A failure worth another try whatever its status."""


def worth_another_try(error: CallError) -> bool:
    """True for the ``RETRY_STATUS`` codes, for failed connections, and for errors that say so themselves."""
    return isinstance(error, RetryableError) or error.status is None or error.status in RETRY_STATUS


def with_retries(call: Callable[[list[str]], list[str]], attempts: int = 6, sleep: Callable[[float], None] = time.sleep) -> Callable[[list[str]], list[str]]:
    """Wrap a completion function: waits of 1.5 s, doubling up to 60 s, with 20 percent of jitter, before each new attempt."""

    def run(prompts: list[str]) -> list[str]:
        for k in range(1, attempts + 1):
            try:
                return call(prompts)
            except CallError as error:
                if k == attempts or not worth_another_try(error):
                    raise
                sleep(min(60.0, 1.5 * 2 ** (k - 1)) * random.uniform(0.8, 1.2))
        return []

    return run


def complete(prompts: DataFrame, prompt: str, model: Callable[[list[str]], list[str]], batch: int = 8) -> DataFrame:
    """Adds ``output`` and ``latency_s`` by a completion function that takes a list of prompts. The one place where Python runs per row."""
    fields = [f for f in prompts.schema if f.name not in ("output", "latency_s")]
    names = [f.name for f in fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), batch):
                part = f.iloc[lo : lo + batch]
                began = time.time()
                out = model(part[prompt].tolist())
                yield part.assign(output=out, latency_s=round((time.time() - began) / len(part), 3))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return prompts.select(*names).mapInPandas(run, f"{schema}, output string, latency_s double")
