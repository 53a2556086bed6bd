"""Generation-log outputs and their archive, as tables partitioned by output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywork.operators.logs import LOG_ORDER, LOG_SCHEMA
from tallywork.sources.problems import write_csv

LOG_OUTPUTS = ("generation_logs", "generation_logs_final", "generation_logs_training")
OUTPUT = T.StructField("output", T.StringType())


def write_generation_logs(logs: DataFrame, folder: str) -> dict[str, str]:
    """Write all records, final records and training records, each sorted; return the paths.

    Each record is given the outputs it belongs to, and all outputs are sorted and written
    together: the logs are computed once, and nothing is read again.
    """
    final, training = F.col("reason") == "final", F.col("flag_for_training")
    outputs = F.array_compact(F.array(F.lit(LOG_OUTPUTS[0]), F.when(final, LOG_OUTPUTS[1]), F.when(training, LOG_OUTPUTS[2])))
    rows = logs.withColumn("output", F.explode(outputs))
    ordered = rows.orderBy("output", *[F.asc_nulls_last(c) for c in LOG_ORDER])
    ordered.write.partitionBy("output").parquet(folder)
    return {name: f"{folder}/output={name}" for name in LOG_OUTPUTS}


def write_csv_outputs(spark: SparkSession, folder: str, paths: dict[str, str], schema: T.StructType = LOG_SCHEMA) -> None:
    """The outputs at ``paths`` again as CSV, in their order, for readers of small logs."""
    for name, path in paths.items():
        write_csv(spark.read.schema(schema).parquet(path), f"{folder}/{name}.csv")


def archive_run_logs(
    spark: SparkSession, folder: str, archive: str, run_id: str, schema: T.StructType = LOG_SCHEMA
) -> DataFrame:
    """Keep all outputs of a run in an archive partitioned by run and output.

    Archiving a run again replaces what the archive has of it.
    """
    whole = T.StructType([*schema.fields, OUTPUT])
    kept = spark.read.schema(whole).parquet(folder).withColumn("run_id", F.lit(run_id))
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "output").parquet(archive)
    archived = T.StructType([*schema.fields, T.StructField("run_id", T.StringType()), OUTPUT])
    return spark.read.schema(archived).parquet(archive).where(F.col("run_id") == run_id)
