"""Feedback that arrives as files, kept as rules by a streaming query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import FEEDBACK


def feedback_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(FEEDBACK).json(folder)


def latest_rules(feedback: DataFrame) -> DataFrame:
    """The last feedback per kind, pattern and target; state is one row a rule."""
    last = F.max(F.struct("revision", "note")).alias("last")
    rules = feedback.groupBy(F.col("subject_kind").alias("kind"), F.col("subject_key").alias("pattern"), F.col("decision").alias("target")).agg(last)
    return rules.select("kind", "pattern", "target", F.col("last.revision").alias("revision"), F.col("last.note").alias("note"))


def keep_rules(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Writes each state of the rules as a folder of its own: a batch that is done again writes the same folder."""

    def write(rules: DataFrame, batch: int) -> None:
        rules.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    writer = latest_rules(feedback_stream(spark, folder)).writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).trigger(availableNow=True).start()
