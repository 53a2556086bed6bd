"""Problem and training sets as CSV.

A CSV value may hold line breaks, so one file is read by one task: use CSV for problem
sets, parquet for large tables. Columns are found by the names in the header, in any order
and among others. Schemas are always given; an all-digit id stays text. An empty text is
written as "" and a missing value as \\N, so both are read back as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROBLEM_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("problem", T.StringType()),
        T.StructField("answer", T.LongType()),
    ]
)
TRAINING_SCHEMA = T.StructType(
    [T.StructField("prompt", T.StringType()), T.StructField("correct_answer", T.StringType())]
)
CSV = {
    "header": True, "quote": '"', "escape": '"', "encoding": "UTF-8", "nullValue": "\\N", "emptyValue": "",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def _strict(name: str, kind: T.DataType) -> Column:
    """A text as its type; one that does not parse is an error, not a missing value."""
    text, value = F.col(f"`{name}`"), F.col(f"`{name}`").try_cast(kind)
    wrong = F.raise_error(F.concat(F.lit(f"{name}: not a {kind.simpleString()}: "), text)).cast(kind)
    return F.when(text.isNotNull() & value.isNull(), wrong).otherwise(value).alias(name)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` by name; a missing one, or a file with another header, is an error."""
    rows = spark.read.options(**CSV, multiLine=True, mode="FAILFAST", enforceSchema=False).csv(path)
    missing = [f.name for f in schema.fields if f.name not in rows.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; it has {', '.join(rows.columns)}")
    return rows.select(*[F.col(f"`{f.name}`") if isinstance(f.dataType, T.StringType) else _strict(f.name, f.dataType) for f in schema.fields])


def scan_problems(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, PROBLEM_SCHEMA)


def scan_training_set(spark: SparkSession, path: str, schema: T.StructType = TRAINING_SCHEMA) -> DataFrame:
    return read_csv(spark, path, schema)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.options(**{**CSV, "emptyValue": '""'}, quoteAll=False).csv(path)


def publish_questions(problems: DataFrame, path: str) -> None:
    """The problem table without its answers."""
    write_csv(problems.drop("answer"), path)
