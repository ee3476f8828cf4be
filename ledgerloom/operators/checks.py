"""Data-quality checks: golds that score themselves, programs that give their gold, figures that stand in their context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import answers, program


def gold_self_score(examples: DataFrame) -> DataFrame:
    """Rows whose gold, written as an answer line, does not score as correct: ``id``, ``gold``, ``status``."""
    s = answers.score(F.concat(F.lit("ANSWER: "), F.col("gold")), F.col("gold"))
    return examples.select("id", "split", "gold", s.alias("s")).where(~F.coalesce(F.col("s.correct"), F.lit(False))).select("id", "split", "gold", F.col("s.status").alias("status"))


def failure_histogram(failures: DataFrame) -> DataFrame:
    """Failures per split and status, most common first."""
    return failures.groupBy(F.concat_ws(":", "split", "status").alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key")


def first_failures(failures: DataFrame, n: int = 15) -> DataFrame:
    """The first ``n`` failures by split and id, to be looked at. (A head operator.)"""
    return failures.orderBy("split", "id").limit(n)


def table_op_report(examples: DataFrame, n: int = 3) -> DataFrame:
    """Per table operation: ``n_rows`` whose program names it, and the first ``n`` ids, as ``first_ids``. (Only these heads are ordered.)"""
    each = []
    for op in program.TABLE_OPS:
        rows = examples.where(F.coalesce(F.col("program").contains(op), F.lit(False))).select("id")
        each.append(rows.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(op).alias("op"), "n_rows", F.lit(None).cast("string").alias("first_ids")))
        each.append(rows.orderBy("id").limit(n).agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("first_ids")).select(F.lit(op).alias("op"), F.lit(None).cast("long").alias("n_rows"), "first_ids"))
    return reduce(DataFrame.unionByName, each).groupBy("op").agg(F.max("n_rows").alias("n_rows"), F.max("first_ids").alias("first_ids"))


def program_gold(examples: DataFrame) -> DataFrame:
    """Rows with a program whose result is not within tolerance of the gold: ``id``, ``value``, ``gold``."""
    rows = examples.where(F.coalesce(F.col("program"), F.lit("")) != "").select("id", "gold", program.execute(F.col("program")).alias("r"), answers.parse_number(F.col("gold")).alias("g"))
    close = F.abs(F.col("r.value") - F.col("g.approx")) <= program.target_tolerance(F.col("g.approx"))
    return rows.where(~F.coalesce(close, F.lit(False))).select("id", F.col("r.value").alias("value"), "gold")


def figures_in_context(examples: DataFrame) -> DataFrame:
    """Figures of programs that do not stand in their context (thousands separators aside): ``id``, ``figure``."""
    rows = examples.select("id", F.regexp_replace("context", r"(?<=\d),(?=\d)", "").alias("ctx"), F.explode(program.operands(F.col("program"))).alias("figure"))
    bare = F.regexp_replace(F.replace(F.col("figure"), F.lit(","), F.lit("")), "^-", "")
    return rows.where(~F.coalesce(F.contains("ctx", bare), F.lit(False))).select("id", "figure").distinct()


def programs_like(examples: DataFrame, pattern: str) -> DataFrame:
    """Rows whose program matches a regular expression."""
    return examples.where(F.coalesce(F.col("program").rlike(pattern), F.lit(False))).select("id", "program")
