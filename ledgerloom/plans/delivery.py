"""Queries of problem 5: run-log rows delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import delivery
from ledgerloom.session import table

COLUMNS = ("row_id", "batch_id", "id", "arm", "eval_set", "model", "ts")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surplus run-log rows."""
    return delivery.surplus_rows(table(spark, sf_dir, "run_log"))


def p5_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one row per answer that stays."""
    return delivery.deduplicate(table(spark, sf_dir, "run_log").select(*COLUMNS)).select("row_id", "batch_id")


def p5_new_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the later half of the batches that no earlier batch has delivered."""
    log = table(spark, sf_dir, "run_log").select(*COLUMNS)
    bounds = log.agg(((F.min("batch_id") + F.max("batch_id")) / 2).alias("cut"))
    cut = bounds.first()["cut"]
    return delivery.new_messages(log.where(F.col("batch_id") > cut), log.where(F.col("batch_id") <= cut)).select("row_id", "batch_id")


_KEYS = r"""lower(regexp_replace(id, '^\s+|\s+$', '', 'g')) AS k_id, lower(regexp_replace(arm, '^\s+|\s+$', '', 'g')) AS k_arm,
lower(regexp_replace(eval_set, '^\s+|\s+$', '', 'g')) AS k_set,
replace(replace(lower(regexp_replace(model, '^\s+|\s+$', '', 'g')), '/', '--'), '.', '-') AS k_model"""
_RANKED = f"""SELECT row_id, batch_id, {{extra}} row_number() OVER (PARTITION BY {{part}} k_id, k_model, k_arm, k_set ORDER BY ts ASC NULLS LAST, row_id) AS rn
FROM (SELECT row_id, batch_id, ts, {_KEYS} FROM run_log)"""

QUERIES = {"p5_found": p5_found, "p5_kept": p5_kept, "p5_new_batch": p5_new_batch}
SQL = {
    "p5_found": f"SELECT row_id FROM ({_RANKED.format(extra='', part='')}) WHERE rn > 1",
    "p5_kept": f"SELECT row_id, batch_id FROM ({_RANKED.format(extra='', part='')}) WHERE rn = 1",
    "p5_new_batch": f"""WITH n AS (SELECT row_id, batch_id, ts, {_KEYS} FROM run_log),
cut AS (SELECT (min(batch_id) + max(batch_id)) / 2.0 AS c FROM run_log),
late AS (SELECT *, row_number() OVER (PARTITION BY k_id, k_model, k_arm, k_set ORDER BY ts ASC NULLS LAST, row_id) AS rn FROM n, cut WHERE batch_id > c)
SELECT row_id, batch_id FROM late WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM n, cut WHERE n.batch_id <= cut.c
AND n.k_id IS NOT DISTINCT FROM late.k_id AND n.k_model IS NOT DISTINCT FROM late.k_model
AND n.k_arm IS NOT DISTINCT FROM late.k_arm AND n.k_set IS NOT DISTINCT FROM late.k_set)""",
}
