"""Résumé files as they arrive: read, parsed and written once each, or kept as refused with a reason.

The folder is a stream of files with a checkpoint, so a later run reads only files that weren't there. Each micro-batch writes its own
folder, ``batch=<number>``, in one go: one that is repeated after a failure replaces what it had written, so a file has one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from talentloom.operators.parsing import PARSER_VERSION, parse_resumes
from talentloom.sources.marketplace import resume_file_texts

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, files_a_batch: int = 10_000) -> DataFrame:
    """The files below a folder as a stream: path, modificationTime, length, content."""
    return spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).load(folder)


def parsed_files(files: DataFrame, resume_id: Column | None = None) -> DataFrame:
    """path, file_type, status, parsed_data (JSON), extracted_text, error of files (path, content).

    Status is Completed, Failed (read, but no résumé) or Refused (not read). ``resume_id`` names a file, by default by its path.
    """
    key = F.col("path") if resume_id is None else resume_id
    texts = resume_file_texts(files).withColumn("resume_id", key)
    good = texts.filter("error IS NULL")
    parsed = parse_resumes(good, "extracted_text", "resume_id").withColumn("parsed_data", F.to_json("parsed_data"))
    told = good.select("resume_id", "path", "file_type").join(parsed, "resume_id")
    columns = ["resume_id", "path", "file_type", "status", "extracted_text", "parsed_data", F.lit(PARSER_VERSION).alias("parser_version"), F.left(F.col("error"), F.lit(1000)).alias("error")]
    refused = texts.filter("error IS NOT NULL").withColumns({"status": F.lit("Refused"), "parsed_data": F.lit(None).cast("string")})
    return told.select(columns).unionByName(refused.select(columns))


def parse_arriving(spark: SparkSession, folder: str, results: str, checkpoint: str, files_a_batch: int = 10_000) -> StreamingQuery:
    """Parses all files that have come since the last run, then ends; results are Parquet below ``results``, by status."""

    def write(batch: DataFrame, number: int) -> None:
        # by status, so that what was refused is a table of its own
        parsed_files(batch).write.mode("overwrite").partitionBy("status").parquet(f"{results}/batch={number}")

    return arriving(spark, folder, files_a_batch).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parsed_results(spark: SparkSession, results: str) -> DataFrame:
    return spark.read.option("basePath", results).parquet(f"{results}/batch=*")
