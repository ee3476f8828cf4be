"""Messages delivered at least once: keep exactly one copy of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that identify one answer of the run log.
ANSWER_KEY = ("id", "model", "arm", "eval_set")
_EDGES = r"(?U)^\s+|\s+$"


def normal_key(name: str) -> Column:
    """A key column trimmed of any white space and lower-cased; ``model`` also in file-name form (``/`` as ``--``, ``.`` as ``-``)."""
    c = F.lower(F.regexp_replace(F.col(name), _EDGES, ""))
    return F.replace(F.replace(c, F.lit("/"), F.lit("--")), F.lit("."), F.lit("-")) if name == "model" else c


def _names(key: tuple[str, ...]) -> list[str]:
    return [f"_k{i}" for i in range(len(key))]


def kept_rows(df: DataFrame, key: tuple[str, ...] = ANSWER_KEY, ts: str = "ts", tie: str = "row_id") -> DataFrame:
    """The normal key and the ``tie`` of the first row of each message, as columns ``_k0..`` and ``_tie``.

    Rank 1 by arrival is the least ``(ts is null, ts, tie is null, tie)`` of a key. It is computed as an aggregate rather than a
    window, so copies are combined before the shuffle and a key that holds a third of the table still costs one row per task.
    Null parts of a key are one value of their own: rows with equal nulls are copies of one message.
    """
    order = F.struct(F.col(ts).isNull().alias("late"), F.col(ts).alias("ts"), F.col(tie).isNull().alias("last"), F.col(tie).alias("tie"))
    ranked = df.select(*[normal_key(k).alias(n) for k, n in zip(key, _names(key))], order.alias("_order"))
    return ranked.groupBy(*_names(key)).agg(F.min("_order").alias("_first")).select(*_names(key), F.col("_first.tie").alias("_tie"))


def _same(key: tuple[str, ...], left: str, right: str, ties: bool = True):
    """Null-safe equality of keys (and ties) of two aliased sides. The tie spreads a hot key over all tasks."""
    on = F.lit(True)
    for n in [*_names(key), *(["_tie"] if ties else [])]:
        on = on & F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
    return on


def surplus_rows(df: DataFrame, key: tuple[str, ...] = ANSWER_KEY, ts: str = "ts", tie: str = "row_id") -> DataFrame:
    """The ``tie`` of every row but the first of each message.

    Rows are matched to the kept ones on key and ``tie`` together, so the shuffle is even however skewed the key is. A row
    that is repeated with its ``tie`` is listed once per further copy. An empty table gives an empty result; a message of one
    row gives none; null ties rank last and are listed as null.
    """
    rows = df.select(*[normal_key(k).alias(n) for k, n in zip(key, _names(key))], F.col(tie).alias("_tie"))
    counted = rows.groupBy(*_names(key), "_tie").agg(F.count(F.lit(1)).alias("_n")).alias("r")
    kept = kept_rows(df, key, ts, tie).withColumn("_kept", F.lit(1)).alias("k")
    left = counted.join(kept, _same(key, "r", "k"), "left").select(F.col("r._tie").alias(tie), (F.col("_n") - F.coalesce("_kept", F.lit(0))).cast("int").alias("_more"))
    once = left.where("_more = 1").select(tie)
    again = left.where("_more > 1").select(F.explode(F.array_repeat(F.col(tie), F.col("_more"))).alias(tie))
    return once.unionByName(again)


def deduplicate(df: DataFrame, key: tuple[str, ...] = ANSWER_KEY, ts: str = "ts", tie: str = "row_id") -> DataFrame:
    """All columns of the first row of each message. Of rows repeated with key and ``tie`` any one stays."""
    return _only(df, kept_rows(df, key, ts, tie), key, tie)


def _only(df: DataFrame, kept: DataFrame, key: tuple[str, ...], tie: str) -> DataFrame:
    wide = df.select(F.struct("*").alias("_row"), *[normal_key(k).alias(n) for k, n in zip(key, _names(key))], F.col(tie).alias("_tie")).alias("r")
    chosen = wide.join(kept.alias("k"), _same(key, "r", "k"), "left_semi")
    return chosen.dropDuplicates([*_names(key), "_tie"]).select("_row.*")


def new_messages(batch: DataFrame, stored: DataFrame, key: tuple[str, ...] = ANSWER_KEY, ts: str = "ts", tie: str = "row_id") -> DataFrame:
    """The rows of ``batch`` to append to ``stored``: the first of each message that ``stored`` has not got.

    Both sides are reduced to one row per key before the anti-join, and keys compare null-safe.
    """
    fresh, have = kept_rows(batch, key, ts, tie).alias("f"), kept_rows(stored, key, ts, tie).alias("h")
    return _only(batch, fresh.join(have, _same(key, "f", "h", ties=False), "left_anti"), key, tie)
