"""Equi-join of a large, skewed table to a side that is unique on the key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on, so there are at most 1 / HOT_SHARE hot keys, whatever the size, and no other key
#: has more than a thousandth of the rows.
HOT_SHARE = 0.001


def hot_keys(left: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """The keys that hold at least ``share`` of the rows of ``left``: at most ``1 / share`` of them.

    Only the key column is read; counts are combined before the shuffle. Null keys never count.
    """
    per_key = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = left.count()
    return [r[0] for r in per_key.where((F.col("_n") >= F.lit(max(100, total * share))) & F.col(key).isNotNull()).select(key).collect()]


def lookup_join(left: DataFrame, right: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """Left join of ``left`` to ``right`` (unique on ``key``), safe when one key holds a large part of ``left``.

    Rows of hot keys (at most ``1 / share`` keys by construction) meet a broadcast of just those rows of ``right``;
    all other rows are shuffled on the key, null keys not at all. Rows without a match, and null keys, have nulls for the columns of ``right``.
    Columns of ``right`` other than the key must not occur in ``left``.
    """
    hot = hot_keys(left, key, share)
    keyed, right = left.where(F.col(key).isNotNull()), right.where(F.col(key).isNotNull())
    no_key = left.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name != key])
    if not hot:
        return keyed.join(right, key, "left").unionByName(no_key)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = keyed.where(~is_hot).join(right.where(~is_hot), key, "left")
    heavy = keyed.where(is_hot).join(F.broadcast(right.where(is_hot)), key, "left")
    return cold.unionByName(heavy).unionByName(no_key)
