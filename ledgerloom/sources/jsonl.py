"""Line-wise JSON: strict and permissive readers, appending writers, and files in a fixed precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

MESSAGES = "id string, messages array<struct<role:string,content:string>>"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_log(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Records of JSON-lines files in the order ``_file, _block, _line``; a missing path gives an empty table.

    ``_block`` is where the part of a file begins that one task reads, ``_line`` grows within it: parts of a file need not be
    numbered in file order by themselves. Blank lines are skipped. A malformed line is an error if ``strict``, else it is left out.
    """
    want = _parse_datatype_string(schema)
    if not _exists(spark, path):
        return spark.createDataFrame([], want).select("*", F.lit("").alias("_file"), F.lit(0).cast("long").alias("_block"), F.lit(0).cast("long").alias("_line"))
    names, order = want.fieldNames(), ("_file", "_block", "_line")
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line")]
    if strict:
        return spark.read.schema(want).option("mode", "FAILFAST").json(path).select("*", *place).select(*names, *order)
    # Lines are parsed by an expression: whether one is malformed is then known whatever columns are asked for.
    parsed = F.from_json("value", StructType([*want.fields]).add("_corrupt_record", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = spark.read.text(path).select(parsed.alias("r"), *place).where("r is not null and r._corrupt_record is null")
    return rows.select(*[F.col(f"r.{n}").alias(n) for n in names], *order)


def done_ids(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Distinct ids in a log, as text; lines without an id are left out."""
    return read_log(spark, path, "id string", strict).where("id is not null").select("id").distinct()


def write_records(df: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object per line, nulls kept."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def facts_dir(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Company-facts documents, one JSON file each (with ``lines`` one a line); what cannot be read as such gives no row, a missing folder none at all."""
    entry = "array<struct<start:string,end:string,val:double,form:string,filed:string,frame:string>>"
    schema = f"cik long, entityName string, facts map<string,map<string,struct<units:map<string,{entry}>>>>, _corrupt_record string"
    if not _exists(spark, path):
        return spark.createDataFrame([], _parse_datatype_string(schema)).select(F.col("cik").alias("cik_str"), F.col("entityName").alias("title"), "facts")
    df = spark.read.schema(schema).option("multiLine", not lines).option("mode", "PERMISSIVE").json(path)
    return df.where("_corrupt_record is null and facts is not null").select(F.col("cik").alias("cik_str"), F.col("entityName").alias("title"), "facts")


def cik_name(cik: Column) -> Column:
    """A company number padded to ten digits, as files of facts are named."""
    return F.lpad(cik.cast("string"), 10, "0")


def universe(spark: SparkSession, path: str) -> DataFrame:
    """The companies of a ticker file (one JSON object from place to company): ``pos``, ``cik``, ``ticker``, ``title``, ``file`` (of its facts).

    Values are taken whatever their keys; a company with several tickers comes out at each place, entries without number not at all.
    """
    each = "map<string,struct<cik_str:bigint,ticker:string,title:string>>"
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.map_values(F.from_json("value", each))).alias("pos", "c"))
    return rows.where("c.cik_str is not null").select("pos", F.col("c.cik_str").alias("cik"), "c.ticker", "c.title", F.concat(F.lit("CIK"), cik_name(F.col("c.cik_str")), F.lit(".json")).alias("file"))
