"""The pipeline's steps as jobs from files to files. Every constant is an argument."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import checks, decontam, facts, report, runlog, sampling, stats, training
from ledgerloom.sources import jsonl, raw

#: Fields of the run log that aggregation reads.
LOG = "id string, model string, arm string, eval_set string, correct boolean, status string"


def build_dataset(spark: SparkSession, source: str, target: str, splits: tuple[str, ...] = ("train", "dev", "test")) -> DataFrame:
    """``{source}/{split}.json`` to ``{target}/{split}``; returns the report per split."""
    rows = {s: raw.build_examples(raw.read_raw(spark, f"{source}/{s}.json"), s) for s in splits}
    for s, df in rows.items():
        df.where("drop_reason is null").drop("drop_reason").write.mode("overwrite").parquet(f"{target}/{s}")
    return raw.split_report(reduce(DataFrame.unionByName, rows.values()))


def decontaminate(spark: SparkSession, train: str, held_out: tuple[str, ...], target: str, n: int = decontam.N_GRAM, threshold: float = decontam.THRESHOLD) -> DataFrame:
    """Training rows below the threshold to ``target``; returns the report."""
    rows, held = spark.read.parquet(train), reduce(DataFrame.unionByName, [spark.read.parquet(p) for p in held_out])
    scores = decontam.decontaminate(rows, held, n=n)
    decontam.kept(rows, scores, threshold=threshold).write.mode("overwrite").parquet(target)
    return decontam.report(scores, threshold)


def stratified_eval(spark: SparkSession, source: str, target: str, n: int = 450, seed: int = 42) -> DataFrame:
    """A sample by leading operator and quartile of context length; returns its composition."""
    rows = spark.read.parquet(source).withColumn("op_group", text.leading_op(F.col("program")))
    rows = sampling.quartile(rows, F.length("context"), "ctx_quartile")
    sampling.stratified(rows, ("op_group", "ctx_quartile"), "id", n, seed).drop("op_group", "ctx_quartile").write.mode("overwrite").parquet(target)
    kept = spark.read.parquet(target).withColumn("op_group", text.leading_op(F.col("program")))
    return sampling.composition(rows, kept, "op_group")


def facts_eval(spark: SparkSession, source: str, target: str, n_companies: int = 60, n_rows: int = 180, seed: int = 7) -> DataFrame:
    """Company-facts files to a time-split evaluation table; returns rows, companies and the range of filing dates."""
    facts.build_eval(jsonl.facts_dir(spark, source), n_companies, n_rows, seed).write.mode("overwrite").parquet(target)
    done = spark.read.parquet(target)
    return done.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("company").alias("n_companies"), F.min("filed").alias("first_filed"), F.max("filed").alias("last_filed"))


def training_records(spark: SparkSession, source: str, target: str, val_target: str, val_fraction: float = 0.05, seed: int = 42, arm: str = "cot") -> DataFrame:
    """Training and validation records as JSON lines; returns rows per disposition."""
    rows = training.dispositions(spark.read.parquet(source))
    split = sampling.seeded_split(training.records(rows, arm), "id", val_fraction, seed)
    for part, path in (("train", target), ("val", val_target)):
        jsonl.write_records(split.where(F.col("part") == part).select("id", "messages"), path)
    return training.disposition_report(rows)


def read_logs(spark: SparkSession, logs: str) -> DataFrame:
    """Run logs of a glob, each id once: files in path order, lines in file order, the first wins."""
    return runlog.first_writes(jsonl.read_log(spark, logs, LOG), order=("_file", "_block", "_line"))


def aggregate(spark: SparkSession, logs: str) -> tuple[DataFrame, DataFrame, str]:
    """Cells, arm tests, and both as markdown."""
    rows = read_logs(spark, logs)
    cells, pairs = stats.cells(rows), stats.arm_pairs(rows)
    return cells, pairs, report.markdown_table(cells, "model", "arm", "eval_set") + "\n\n" + report.markdown_table(pairs, "model", "eval_set", "arm_a", "arm_b") + "\n"


def compare(spark: SparkSession, logs: str, model: str, base: str, arm: str = "cot", gate_set: str = "finqa_test", append_to: str = "") -> str:
    """The gate report of two models, as a section that replaces its earlier self in ``append_to``."""
    got = stats.compare_models(read_logs(spark, logs), model, base, arm)
    return report.upsert_section(append_to, "comparison", report.gate_report(got, model, base, gate_set))


def smoke_golds(spark: SparkSession, source: str, splits: tuple[str, ...] = ("dev",), n: int = 200) -> DataFrame:
    """Failures of golds to score themselves, over the first ``n`` raw records of each split. (A head operator.)"""
    rows = [raw.build_examples(raw.read_raw(spark, f"{source}/{s}.json").where(F.col("pos") < n), s) for s in splits]
    return checks.failure_histogram(checks.gold_self_score(reduce(DataFrame.unionByName, rows)))
