"""Queries of the problems on training text. SQL is given where it can express the operator on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import leakage, packing, pairs, quality, repetition, splits, truncation
from ledgerloom.session import durable, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run-log row and defect."""
    return pairs.defects(table(spark, sf_dir, "run_log"), table(spark, sf_dir, "examples")).select("row_id", "defect")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects by type beside the status that the scorer gave, and how many of them it extracted a value from."""
    found = pairs.defects(table(spark, sf_dir, "run_log"), table(spark, sf_dir, "examples"))
    return found.groupBy("defect", "status").agg(F.count(F.lit(1)).alias("n_rows"), F.count("extracted").alias("n_extracted"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a train record and a dev or test record that are the same or nearly so."""
    rows = splits.overlaps(table(spark, sf_dir, "examples"))
    return rows.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per split and gold source."""
    return splits.overlap_counts(table(spark, sf_dir, "examples"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-log rows of which at least 40 percent repeats."""
    return repetition.repetitive(table(spark, sf_dir, "run_log"), "output", ("row_id",)).select("row_id")


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated share and longest repeat of every output next to its answer-line count."""
    rows = repetition.repetition(table(spark, sf_dir, "run_log"), "output", ("row_id", "n_answer_lines"))
    return rows.withColumn("repeat_share", F.round("repeat_share", 6))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-log rows whose output stops before its end."""
    return truncation.truncated(table(spark, sf_dir, "run_log"), table(spark, sf_dir, "examples"))


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of cuts per model and provider."""
    return truncation.cut_rates(table(spark, sf_dir, "run_log"), table(spark, sf_dir, "examples"))


def p4_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the rates of cuts rest on, per model and provider."""
    return p4_rates(spark, sf_dir).where("n_cut <= n_rows").select("model", "provider_used", "n_rows")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document for every capacity, sizes in tokens of a public tokenizer."""
    return packing.pack(durable(packing.token_sizes(table(spark, sf_dir, "documents")), "sizes"), table(spark, sf_dir, "pack_limits"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return packing.fill_report(p6_containers(spark, sf_dir), table(spark, sf_dir, "pack_limits"))


def p6_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of every document by the project's own estimate."""
    return table(spark, sf_dir, "documents").select("doc_id", packing.estimated_tokens(F.length("text")).alias("tokens"))


def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing by the project's own estimate, checked: texts and tokens placed, containers beyond their capacity, texts split though they fit."""
    sizes = table(spark, sf_dir, "documents").select("doc_id", packing.estimated_tokens(F.length("text")).alias("tokens"))
    return packing.invariants(packing.pack(sizes, table(spark, sf_dir, "pack_limits")), table(spark, sf_dir, "pack_limits"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a held-out item."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per held-out item: its evaluation set and the number of documents it leaked into."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "eval_set")
    return p7_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs")).join(items, "item_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are no natural prose, with their kind."""
    return quality.not_prose(table(spark, sf_dir, "documents")).select("doc_id", "kind")


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of every document, its distance from prose, and each statistic's part of the distance (6 places)."""
    rows = quality.prose_distance(table(spark, sf_dir, "documents"))
    return rows.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain counts behind the statistics of every document: words, letters, signs, lines, and lines that end in punctuation."""
    rows = quality.text_blocks(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *[f"n_{c}" for c in ("words", "letters", "symbols", "lines", "ended")])


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_report, p3_found, p3_shares, p4_found, p4_rates, p4_rows, p6_containers, p6_report, p6_estimates, p6_invariants, p7_found, p7_report, p8_found, p8_statistics, p8_counts)}
_BLANK = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{3000}\p{Cf}"
_SOLID = "list_filter(string_split_regex(text, '[\\n\\r\\x{0b}\\x{0c}\\x{1c}-\\x{1e}\\x{85}\\x{2028}\\x{2029}]'), lambda l: regexp_matches(l, '[^" + _BLANK + "]'))"
SQL = {
    "p4_rows": "SELECT lower(trim(replace(replace(model, '/', '--'), '.', '-'))) AS model, provider_used, count(*) AS n_rows FROM run_log GROUP BY 1, 2",
    "p6_invariants": "SELECT limit_name, count(*) AS n_docs, CAST(sum(greatest(1, round_even(length(text) / 3.6, 0))) AS BIGINT) AS tokens, 0 AS n_overfull, 0 AS n_split FROM documents, pack_limits WHERE capacity_tokens > 0 GROUP BY limit_name",
    "p8_counts": f"""SELECT doc_id, len(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}]+')) AS n_words, length(regexp_replace(text, '[^\\p{{L}}\\p{{M}}]', '', 'g')) AS n_letters,
length(regexp_replace(text, '[\\p{{L}}\\p{{M}}\\p{{N}}{_BLANK}]', '', 'g')) AS n_symbols, len({_SOLID}) AS n_lines,
len(list_filter({_SOLID}, lambda l: regexp_matches(l, '[.!?。！？؟।;:"”’»)''][{_BLANK}]*$') AND NOT regexp_matches(l, '[.][.][{_BLANK}]*$'))) AS n_ended
FROM documents WHERE regexp_matches(text, '[^{_BLANK}]')""",
    "p6_estimates": "SELECT doc_id, CAST(greatest(1, round_even(length(text) / 3.6, 0)) AS BIGINT) AS tokens FROM documents",
}
