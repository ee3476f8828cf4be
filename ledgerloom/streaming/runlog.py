"""Streaming forms of the run log: scoring as answers arrive, and dropping what was delivered before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.answers import score
from ledgerloom.operators.delivery import ANSWER_KEY, deduplicate, new_messages, normal_key


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Run-log files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def scored(stream: DataFrame) -> DataFrame:
    """Answers with their score; works on a stream as on a table."""
    return stream.select("row_id", *ANSWER_KEY, "ts", score(F.col("output"), F.col("gold")).alias("s")).select("row_id", *ANSWER_KEY, "ts", F.col("s.correct").alias("correct"), F.col("s.status").alias("status"))


#: Parts of a target table, by a hash of the key; a micro-batch reads only the parts that its keys are in.
PARTS = 256


def append_new(batch: DataFrame, path: str) -> None:
    """Append the messages of a micro-batch that the table at ``path`` has not got, exactly one copy each.

    The table is kept in folders ``key_part=k`` by a hash of the normal key, so a small batch is held against few of them.
    """
    spark = batch.sparkSession
    batch = batch.withColumn("key_part", F.pmod(F.xxhash64(*map(normal_key, ANSWER_KEY)), F.lit(PARTS)).cast("int"))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        touched = [r[0] for r in batch.select("key_part").distinct().collect()]  # PARTS at most
        had = spark.read.schema(batch.schema).parquet(path).where(F.col("key_part").isin(touched))
        new_messages(batch, had).write.mode("append").partitionBy("key_part").parquet(path)
    else:
        deduplicate(batch).write.partitionBy("key_part").parquet(path)


def _append_stream(stream: DataFrame, target: str, checkpoint: str) -> None:
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: append_new(df, target)).start()
    query.awaitTermination()


def score_stream(spark: SparkSession, source: str, schema, target: str, checkpoint: str) -> None:
    """Score all files there are, append each answer once to ``target``, and stop. A restart goes on where it stopped."""
    _append_stream(scored(read_stream(spark, source, schema)), target, checkpoint)


def without_redelivery(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Append one copy of each answer of ``stream`` to ``target``, with all columns, and stop at the end of what there is.

    Null and late ``ts`` count like any other: a micro-batch is held against all of ``target``, so no watermark drops a first
    copy. The copy that stays is the earliest (as in the batch operator) of the first micro-batch that has the answer. A
    batch that is played again after a failure adds nothing.
    """
    _append_stream(stream, target, checkpoint)
