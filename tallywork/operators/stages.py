"""Writing a narrow intermediate once, where two branches of a plan would compute it twice."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallywork.session import run_folder


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df`` from a table in the shared folder; a lost executor loses nothing."""
    path = run_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
