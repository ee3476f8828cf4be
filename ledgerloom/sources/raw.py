"""Raw JSON records to the example table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from ledgerloom.functions.answers import select_gold
from ledgerloom.functions.text import clean_text, strip

RAW = "array<struct<pre_text:array<string>,post_text:array<string>,table:array<array<string>>,qa:struct<question:string,program:string,exe_ans:string,answer:string>>>"


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file that holds one JSON array (read whole by one task, so below 2 GB; larger splits as JSON lines, see ``read_raw_lines``): ``pos`` (place in the array) and the record's fields."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", RAW)).alias("pos", "r"))
    return rows.select("pos", "r.*")


def read_raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same from JSON lines, for splits that are too large for one array: files are read in parts, ``pos`` counts in file order.

    Places come from the rows of the parts before (one number per part), so no task sees more than its part. Lines that hold no
    record are left out.
    """
    record = _parse_datatype_string(RAW).elementType
    part = ("_file", "_block")
    rows = spark.read.text(path).select(F.from_json("value", record).alias("r"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    rows = rows.where(F.col("r.qa").isNotNull())
    sizes = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = F.row_number().over(Window.partitionBy(*part).orderBy("_line")) - 1
    return rows.withColumn("_rank", ranked).join(sizes.withColumn("_before", before).select(*part, "_before"), list(part)).select((F.col("_before") + F.col("_rank")).cast("int").alias("pos"), "r.*")


def _prose(items: Column) -> Column:
    """Non-blank items, cleaned, joined by a space; the blank test comes before the cleaning."""
    return F.array_join(F.transform(F.filter(items, lambda x: strip(F.coalesce(x, F.lit(""))) != ""), clean_text), " ")


def context_text(pre: Column, table: Column, post: Column) -> Column:
    """Text before, table and text after, one under another; cells are joined by bars, rows without any text left out."""
    rows = F.transform(table, lambda row: F.transform(row, lambda c: clean_text(F.coalesce(c, F.lit("None")))))
    lines = F.transform(F.filter(rows, lambda row: F.exists(row, lambda c: c != "")), lambda row: F.array_join(row, " | "))
    grid = F.when(F.size(table) > 0, F.array_join(lines, "\n"))
    parts = [F.when(F.size(F.filter(x, lambda t: strip(F.coalesce(t, F.lit(""))) != "")) > 0, _prose(x)) for x in (pre, post)]
    return F.concat_ws("\n", parts[0], grid, parts[1])


def build_examples(raw: DataFrame, split: str) -> DataFrame:
    """The example table of a split, with ``drop_reason`` (null for rows to keep); ids count all raw records, kept or not."""
    gold = select_gold(F.col("qa.exe_ans"), F.col("qa.answer"))
    return raw.withColumn("_g", gold).select(
        F.concat(F.lit(f"{split}-"), F.col("pos").cast("string")).alias("id"),
        F.lit(split).alias("split"),
        clean_text(F.col("qa.question")).alias("question"),
        context_text(F.col("pre_text"), F.col("table"), F.col("post_text")).alias("context"),
        F.col("_g.gold").alias("gold"),
        F.col("_g.gold_source").alias("gold_source"),
        F.coalesce(F.col("qa.program"), F.lit("")).alias("program"),
        F.col("_g.drop_reason").alias("drop_reason"),
    )


def split_report(examples: DataFrame) -> DataFrame:
    """Per split: raw and kept rows, rows per reason and per source, and the excluded share (4 places)."""
    n, out = F.count(F.lit(1)), F.count("drop_reason")
    each = [F.count_if(F.col("drop_reason") == r).alias(f"dropped_{r}") for r in ("empty_gold", "non_numeric_gold")]
    src = [F.count_if(F.col("gold_source") == s).alias(f"gold_{s}") for s in ("exe_ans", "answer_fallback")]
    return examples.groupBy("split").agg(n.alias("n_raw"), (n - out).alias("n_kept"), *each, *src, F.round(out / n, 4).alias("excluded_share"))
