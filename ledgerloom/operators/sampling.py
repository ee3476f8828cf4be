"""Deterministic sampling: quantile bins, stratified samples, exact splits, seeded order by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def seeded(key: str, seed: int) -> Column:
    """A pseudo-random order of rows: the md5 of seed and key. The same on every engine, and for every partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def quartile(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the quartile bin (0 to 3) of ``value``: interpolated edges, right-closed, ties never split; null values have no bin.

    The edges are exact: one task holds the distinct values with their counts, so this is for values such as lengths, of which
    there are far fewer than rows.
    """
    edges = df.agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).first()["q"]
    if edges is None:
        return df.withColumn(name, F.lit(None).cast("int"))
    bins = F.when(value <= edges[0], 0).when(value <= edges[1], 1).when(value <= edges[2], 2).when(value.isNotNull(), 3)
    return df.withColumn(name, bins)


def stratified(df: DataFrame, strata: tuple[str, ...], key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer), each stratum in proportion with at least one row, in seeded order.

    Strata give ``max(1, round(share * n))`` rows; what is too much is taken off, and what is missing added from the other
    rows, both in seeded order. Only keys and hashes are ranked; a stratum of any size is cut by its hash at a quantile found
    by an aggregate, so no stratum passes through one task.
    """
    total = df.count()
    if total <= n:
        return df
    slim = df.select(*strata, key, seeded(key, seed).alias("_h"))
    sizes = slim.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    take = sizes.withColumn("_take", F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(n / total), 0).cast("long")))
    chosen = smallest(slim, strata, take.select(*strata, "_take"), "_h", key).select(key, "_h")
    have = chosen.count()
    if have > n:
        chosen = chosen.orderBy("_h", key).limit(n)
    elif have < n:
        rest = slim.join(chosen.select(key), key, "left_anti").select(key, seeded(key, seed + 1).alias("_h"))
        chosen = chosen.unionByName(rest.orderBy("_h", key).limit(n - have))
    return df.join(chosen.select(key), key, "left_semi")


def smallest(df: DataFrame, group: tuple[str, ...], take: DataFrame, order: str, key: str, buckets: int = 4096) -> DataFrame:
    """The first ``_take`` rows of each group by the hash column ``order``, without bringing a group into one task.

    Rows are counted per group and leading hash bits; running counts over those few buckets find the bucket where a group's
    quota ends; only rows of that bucket are ranked.
    """
    bucket = F.conv(F.substring(order, 1, 3), 16, 10).cast("int")
    rows = df.withColumn("_b", F.pmod(bucket, F.lit(buckets)))
    counts = rows.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    edges = counts.withColumn("_before", F.coalesce(before, F.lit(0))).join(take, list(group)).withColumn("_left", F.col("_take") - F.col("_before")).where("_left > 0")
    whole, cut = edges.where("_left >= _c"), edges.where("_left < _c")
    on = [*group, "_b"]
    ranked = rows.join(cut.select(*on, "_left"), on).withColumn("_r", F.row_number().over(W.partitionBy(*on).orderBy(order, key))).where("_r <= _left")
    return rows.join(whole.select(*on), on, "left_semi").drop("_b").unionByName(ranked.drop("_b", "_r", "_left"))


def seeded_split(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Adds ``part``: the first ``round(n * fraction)`` rows in seeded order are ``val``, the rest ``train``. Sizes are exact."""
    n = df.count()
    size = int(round(n * fraction))
    slim = df.select(key, seeded(key, seed).alias("_h"), F.lit(1).alias("_g"))
    take = df.sparkSession.range(1).select(F.lit(1).alias("_g"), F.lit(size).cast("long").alias("_take"))
    val = smallest(slim, ("_g",), take, "_h", key).select(key, F.lit("val").alias("_part"))
    return df.join(val, key, "left").withColumn("part", F.coalesce("_part", F.lit("train"))).drop("_part")


def composition(population: DataFrame, sample: DataFrame, column: str) -> DataFrame:
    """Share of each value of ``column`` in the population and in the sample, side by side (6 places); absent ones have 0."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
        total = counts.agg(F.sum("_n")).first()[0] or 1
        return counts.select(column, F.round(F.col("_n") / F.lit(total), 6).alias(name))

    both = shares(population, "population_share").join(shares(sample, "sample_share"), column, "full_outer")
    return both.select(column, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("population_share", "sample_share")])


def medians(population: DataFrame, sample: DataFrame, value: Column, name: str) -> DataFrame:
    """One row: the interpolated median of ``value`` in the population and in the sample, rounded down, as columns ``population_<name>`` and ``sample_<name>``."""
    both = population.select(value.alias("p"), F.lit(None).alias("s")).unionByName(sample.select(F.lit(None).alias("p"), value.alias("s")))
    return both.agg(*[F.floor(F.percentile(c, F.lit(0.5))).alias(f"{side}_{name}") for c, side in (("p", "population"), ("s", "sample"))])


def head_of(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in an explicit order."""
    return df.orderBy(*order).limit(n)
