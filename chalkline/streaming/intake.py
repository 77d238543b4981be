"""Packets as they arrive: each micro-batch of files is one plan of whole reviews, appended to tables once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chalkline.plans.review import review
from chalkline.sources.packets import parse_packets

#: Files of a micro-batch at most, so that a backlog doesn't become one plan.
BATCH_FILES = 1000


def arriving(spark: SparkSession, folder: str, batch_files: int = BATCH_FILES) -> DataFrame:
    """parse_packets() of the JSON files that appear in folder."""
    raw = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", batch_files).load(folder)
    return parse_packets(raw.select(F.col("value"), F.col("_metadata.file_path").alias("file")))


def land(output: str):
    """For foreachBatch: a batch's tables go to folders of its number, which a repeated batch overwrites; so none counts twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.where("refusal is not null").select("review_id", "file", "refusal").write.mode("overwrite").parquet(f"{output}/refused/batch={number}")
        for name, table in vars(review(batch)).items():
            table.write.mode("overwrite").parquet(f"{output}/{name}/batch={number}")

    return write


def ingest(spark: SparkSession, folder: str, output: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start landing reviews from folder in output; progress is kept in checkpoint, a folder all executors share."""
    writer = arriving(spark, folder).writeStream.foreachBatch(land(output)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
