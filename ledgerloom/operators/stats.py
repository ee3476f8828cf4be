"""Accuracy cells, exact intervals and tests, and gates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.answers import NO_LINE, NON_NUMERIC, OK
from ledgerloom.functions.text import let

#: Fixed values of the gates, in percentage points.
GATE_POINTS, PHASE1_POINTS, PHASE1_PARTIAL = 8.0, 3.5, 1.0


def binomial_interval(n: Column, k: Column, lower: float = 0.025, upper: float = 0.975) -> Column:
    """A struct ``lo, hi``: the least counts whose cumulative probability under Binomial(n, k/n) reaches each share, by n.

    It is what a percentile bootstrap of 0/1 flags tends to as resamples grow: no resampling, and nothing random. Counts are
    walked within ten standard deviations of k, each probability from the one before, so the work grows with the square root
    of n and nothing is stored. Null for n = 0.
    """
    spread = F.ceil(F.sqrt(n * (k / n) * (1 - k / n)) * 10 + 10).cast("long")
    bound = F.struct(n.cast("long").alias("n"), k.cast("long").alias("k"), F.greatest(F.lit(0), k - spread).cast("long").alias("lo"), F.least(n, k + spread).cast("long").alias("hi"))

    def walk(b: Column) -> Column:
        odds = b["k"] / (b["n"] - b["k"])
        counts = F.sequence(b["lo"] + 1, b["hi"])
        ratio = lambda m, i: m * (b["n"] - i + 1) / i * odds
        total = F.aggregate(counts, F.struct(F.lit(1.0).alias("m"), F.lit(1.0).alias("s")), lambda a, i: F.struct(ratio(a["m"], i).alias("m"), (a["s"] + ratio(a["m"], i)).alias("s")))["s"]

        def find(t: Column) -> Column:
            low, high = t * (lower - 1e-12), t * (upper - 1e-12)
            start = F.struct(F.lit(1.0).alias("m"), F.lit(1.0).alias("s"), *[F.when(F.lit(1.0) >= x, b["lo"]).otherwise(b["lo"] + 1).alias(y) for x, y in ((low, "lo"), (high, "hi"))])

            def step(a: Column, i: Column) -> Column:
                m = ratio(a["m"], i)
                s = a["s"] + m
                return F.struct(m.alias("m"), s.alias("s"), *[F.when(s >= x, a[y]).otherwise(i + 1).alias(y) for x, y in ((low, "lo"), (high, "hi"))])

            got = F.aggregate(counts, start, step)
            return F.struct((got["lo"] / b["n"]).alias("lo"), (got["hi"] / b["n"]).alias("hi"))

        return let(total, find)

    flat = F.struct((k / n).alias("lo"), (k / n).alias("hi"))
    return F.when(n == 0, F.lit(None).cast("struct<lo:double,hi:double>")).when((k == 0) | (k == n), flat).otherwise(let(bound, walk))


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided p of the discordant counts ``b`` and ``c``: 1 for none, else twice the lower binomial tail at one half, at most 1."""
    n, k = (b + c).cast("long"), F.least(b, c).cast("long")

    def tail(x: Column) -> Column:
        first = -x["n"] * F.log(F.lit(2.0))
        acc = F.struct(first.alias("lp"), F.exp(first).alias("s"))

        def step(a: Column, i: Column) -> Column:
            lp = a["lp"] + F.log((x["n"] - i + 1).cast("double")) - F.log(i.cast("double"))
            return F.transform(F.array(lp), lambda v: F.struct(v.alias("lp"), (a["s"] + F.exp(v)).alias("s")))[0]

        terms = F.when(x["k"] >= 1, F.sequence(F.lit(1).cast("long"), x["k"])).otherwise(F.array().cast("array<bigint>"))
        return F.least(F.lit(1.0), 2 * F.aggregate(terms, acc, step)["s"])

    return F.when((n == 0) | (b == c), 1.0).otherwise(F.transform(F.array(F.struct(n.alias("n"), k.alias("k"))), tail)[0])


def cells(log: DataFrame, keys: tuple[str, ...] = ("model", "arm", "eval_set"), digits: int = 4) -> DataFrame:
    """Per cell: ``n``, accuracy, 95 % interval, and a count per status. One aggregate; flags are combined before the shuffle."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in (OK, NO_LINE, NON_NUMERIC)]
    base = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("k"), *counts)
    n, k = F.col("n"), F.col("k")
    return base.withColumn("ci", binomial_interval(n, k)).select(
        *keys, "n", F.round(k / n, digits).alias("acc"), F.round("ci.lo", digits).alias("ci_lo"), F.round("ci.hi", digits).alias("ci_hi"),
        *[f"n_{s}" for s in (OK, NO_LINE, NON_NUMERIC)],
    )


def status_map(log: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per cell a map from status to count."""
    two = log.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("n"))
    return two.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("status_counts"))


def _discordance(joined: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    a, b = F.col("a_ok"), F.col("b_ok")
    got = joined.groupBy(*keys).agg(F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c"), F.count(F.lit(1)).alias("n_shared"))
    return got.withColumn("discordant", F.col("b") + F.col("c")).withColumn("p", mcnemar_p(F.col("b"), F.col("c")))


def arm_pairs(log: DataFrame, id_key: str = "id") -> DataFrame:
    """McNemar test of every two arms of a model on an evaluation set, over the ids both have answered.

    Repeated answers of an arm count once (right if any is; pass ``first_writes`` for the first). The arms' flags of one id,
    one per arm, are brought to one row by an aggregate, so each answer is shuffled once, however many arms.
    """
    once = log.groupBy("model", "eval_set", id_key, "arm").agg(F.max("correct").alias("correct"))
    flags = once.groupBy("model", "eval_set", id_key).agg(F.sort_array(F.collect_list(F.struct("arm", "correct"))).alias("f"))
    pairs = F.flatten(F.transform("f", lambda x, i: F.transform(F.slice("f", i + 2, F.size("f")), lambda y: F.struct(x["arm"].alias("arm_a"), y["arm"].alias("arm_b"), x["correct"].alias("a_ok"), y["correct"].alias("b_ok")))))
    rows = flags.select("model", "eval_set", F.explode(pairs).alias("p")).select("model", "eval_set", "p.*")
    return _discordance(rows, ("model", "eval_set", "arm_a", "arm_b"))


def compare_models(log: DataFrame, model: str, base: str, arm: str, id_key: str = "id", digits: int = 4) -> DataFrame:
    """Per evaluation set, one model against another on the ids both answered: accuracies, intervals, McNemar, ids on one side only, gates."""
    wanted = log.where((F.col("arm") == arm) & F.col("model").isin(model, base))
    has = [F.max(F.when(F.col("model") == m, F.col("correct").cast("int"))).alias(x) for m, x in ((model, "a"), (base, "b"))]
    rows = wanted.groupBy("eval_set", id_key).agg(*has)
    a, b = F.col("a") == 1, F.col("b") == 1
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    got = rows.groupBy("eval_set").agg(
        F.count_if(both).alias("n"), F.count_if(both & a).alias("ka"), F.count_if(both & b).alias("kb"),
        F.count_if(both & a & ~b).alias("b"), F.count_if(both & ~a & b).alias("c"),
        F.count_if(F.col("a").isNotNull() & F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull() & F.col("b").isNotNull()).alias("only_b"),
    )
    got = got.where("n > 0").withColumns({"ia": binomial_interval(F.col("n"), F.col("ka")), "ib": binomial_interval(F.col("n"), F.col("kb"))})
    got = got.select(
        "eval_set", "n", "only_a", "only_b", "b", "c", mcnemar_p(F.col("b"), F.col("c")).alias("p"),
        F.round(F.col("ka") / F.col("n"), digits).alias("acc_a"), F.round("ia.lo", digits).alias("lo_a"), F.round("ia.hi", digits).alias("hi_a"),
        F.round(F.col("kb") / F.col("n"), digits).alias("acc_b"), F.round("ib.lo", digits).alias("lo_b"), F.round("ib.hi", digits).alias("hi_b"),
        F.round((F.col("ka") - F.col("kb")) / F.col("n") * 100, 4).alias("delta_points"),
    )
    apart = (F.col("lo_a") > F.col("hi_b")) | (F.col("lo_b") > F.col("hi_a"))
    return got.withColumn("gate", gate(F.col("delta_points"), apart)).withColumn("phase1", phase1(F.col("delta_points"), apart))


def gate(delta: Column, apart: Column, points: float = GATE_POINTS) -> Column:
    """``PASS`` if the gain reaches ``points`` and the intervals are apart, else ``FAIL``."""
    return F.when((delta >= points) & apart, "PASS").otherwise("FAIL")


def phase1(delta: Column, apart: Column) -> Column:
    """The later gate: ``pass``, ``partial``, ``fail``, or ``unclassified`` for a large gain whose intervals overlap."""
    return F.when((delta >= PHASE1_POINTS) & apart, "pass").when(delta >= PHASE1_POINTS, "unclassified").when(delta >= PHASE1_PARTIAL, "partial").otherwise("fail")


def bootstrap(log: DataFrame, keys: tuple[str, ...], order: str = "row_id", resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """The percentile bootstrap by resampling, draw for draw: ``n, ci_lo, ci_hi`` per cell.

    The stream of a cell is fixed: PCG64 of ``seed`` draws ``resamples`` times n numbers below 2, which are passed over, then as many
    indexes below n; each row of those picks flags in the order of ``order``. A cell is drawn by one task, in blocks of rows, so it
    needs its flags (a byte each) in memory and ``resamples * n`` steps; for large cells ``cells`` has the limit of this at once.
    """
    schema = ", ".join(f"`{k}` {log.schema[k].dataType.simpleString()}" for k in keys) + ", n long, ci_lo double, ci_hi double"

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        flags = frame.sort_values(order)["correct"].fillna(False).to_numpy(bool)
        lo, hi = resampled_interval(flags, resamples, seed)
        return frame[list(keys)].iloc[:1].assign(n=len(flags), ci_lo=lo, ci_hi=hi)

    return log.select(*keys, order, "correct").groupBy(*keys).applyInPandas(draw, schema)


def resampled_interval(flags: np.ndarray, resamples: int, seed: int) -> tuple[float, float]:
    """The 2.5 and 97.5 percentiles of resampled means of ``flags``."""
    rng, n = np.random.default_rng(seed), len(flags)
    rows = max(1, 4_000_000 // n)
    blocks = [min(rows, resamples - lo) for lo in range(0, resamples, rows)]
    for k in blocks:
        rng.integers(0, 2, size=(k, n))
    means = np.concatenate([flags[rng.integers(0, n, size=(k, n))].mean(axis=1) for k in blocks])
    return float(np.percentile(means, 2.5)), float(np.percentile(means, 97.5))
