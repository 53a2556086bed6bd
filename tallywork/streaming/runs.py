"""Reading tables as streams and running a stream over all that is there."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessorHandle

from tallywork.session import run_folder


def milliseconds(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


def stream_files(spark: SparkSession, path: str, files_per_batch: int | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Parquet files as a stream, with the schema they have if none is given."""
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # The stream reader wants a folder or a pattern; a pattern may also name one file.
    pattern = f"{path[:-8]}[.]parquet" if path.endswith(".parquet") else path
    return reader.parquet(pattern)


def never_missing(key: Column | str) -> Column:
    """A key as a text that is never missing; stateful operators in Python mix up keys if some are."""
    return F.coalesce(F.concat(F.lit("="), (F.col(key) if isinstance(key, str) else key).cast("string")), F.lit(""))


def key_of(text: Column | str, kind: str) -> Column:
    """The key that ``never_missing`` has made a text of, as ``kind``."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text != "", F.substring(text, 2, 1 << 30).cast(kind))


#: Keys of the stateful operators in Python: each holds many keys of the data, as a call per key takes its time.
#: A stream keeps this number for good.
BUCKETS = 64


def bucket_of(*keys: Column | str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class HeldTable:
    """A table that a bucket keeps in its state, with the columns of ``schema``."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, schema: str):
        self.state = handle.getValueState(name, "rows binary")
        fields = [f.split(" ", 1) for f in schema.split(", ")]
        kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
        kinds |= {f"array<{k}>": pa.list_(v) for k, v in kinds.items()}
        self.schema = pa.schema([(name, kinds[kind]) for name, kind in fields])
        self.columns = self.schema.names

    def _table(self) -> pa.Table:
        if not self.state.exists():
            return self.schema.empty_table()
        return pa.ipc.open_stream(bytes(self.state.get()[0])).read_all()

    def _keep(self, table: pa.Table) -> None:
        if not len(table):
            self.state.clear()
            return
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.schema) as writer:
            writer.write_table(table)
        self.state.update((sink.getvalue().to_pybytes(),))

    def get(self) -> pd.DataFrame:
        return self._table().to_pandas()

    def put(self, rows: pd.DataFrame) -> None:
        self._keep(pa.Table.from_pandas(rows[self.columns], self.schema, preserve_index=False))

    def rows(self) -> list[tuple]:
        return list(zip(*(c.to_pylist() for c in self._table().columns)))

    def put_rows(self, rows: Iterable[tuple]) -> None:
        columns = list(zip(*rows)) or [()] * len(self.columns)
        self._keep(pa.table([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema))


# Typed states and timers need this store of the two that come with Spark.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_settings(spark: SparkSession, count: int | None) -> Iterator[None]:
    """Streams started inside keep their state in ``count`` partitions, the session's number if None.

    A stream keeps this number and its store for good, and adaptive execution does not merge them.
    """
    wanted = {"spark.sql.shuffle.partitions": str(count) if count else None, "spark.sql.streaming.stateStore.providerClass": STATE_STORE}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value or before[key])
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def write_available(
    stream: DataFrame, label: str, mode: str = "append", partitions: int | None = None, folder: str | None = None
) -> str:
    """Run ``stream`` until its input is used up and return the folder of what it wrote.

    Appended rows go to a file sink. Updated rows are kept per micro-batch in batch=N, which
    a repeated batch overwrites. Given the ``folder`` of an earlier run, the stream goes on
    where that ended.
    """
    spark = stream.sparkSession
    folder = folder or run_folder(spark, label)
    out, progress = f"{folder}/rows", f"{folder}/progress"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", progress).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", out)
    else:
        writer = writer.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{out}/batch={batch}"))
    with state_settings(spark, partitions):
        query = writer.start()
    query.awaitTermination()
    return out


def run_available(
    stream: DataFrame, label: str, mode: str = "append", partitions: int | None = None, folder: str | None = None
) -> DataFrame:
    """What ``write_available`` wrote; updated rows come with the number of their ``batch``."""
    schema = stream.schema
    if mode != "append":
        schema = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    out = write_available(stream, label, mode, partitions, folder)
    return stream.sparkSession.read.option("basePath", out).schema(schema).parquet(out)


def run_and_stream(stream: DataFrame, label: str, partitions: int | None = None, folder: str | None = None) -> DataFrame:
    """What ``write_available`` wrote, as the stream of a next query."""
    out = write_available(stream, label, partitions=partitions, folder=folder)
    return stream.sparkSession.readStream.schema(stream.schema).parquet(out)


def split_late(stream: DataFrame, ts: str, delay: str, label: str, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Run ``stream`` until its input is used up: rows in time as a stream, and the late ones as a table.

    A row is late if it is older, by more than ``delay``, than the newest row of the
    micro-batches before its own. Stateful operators would drop such rows without a trace;
    here they are kept, with the number of their ``batch``. Each micro-batch is one table
    with the newest time so far beside it, both overwritten if the batch is repeated, so a
    run with the same ``folder`` goes on where an earlier one ended. An operator behind it
    needs the same delay, and should read no fewer files at a time than a micro-batch wrote,
    unless the delay covers the time one micro-batch spans.
    """
    spark = stream.sparkSession
    folder = folder or run_folder(spark, label)
    out, newest = f"{folder}/rows", f"{folder}/newest"

    def split(rows: DataFrame, batch: int) -> None:
        before = spark.read.parquet(f"{newest}/batch={batch - 1}").first()[0] if batch else None
        mark = F.lit(before).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        late = F.coalesce(F.col(ts) < mark, F.lit(False))
        rows.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(f"{out}/batch={batch}")
        seen = spark.read.schema(stream.schema).parquet(f"{out}/batch={batch}").agg(F.max(ts).alias("t"))
        seen.select(F.greatest("t", F.lit(before).cast("timestamp")).alias("newest")).write.mode("overwrite").parquet(f"{newest}/batch={batch}")

    writer = stream.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    writer.foreachBatch(split).start().awaitTermination()
    in_time = stream_files(spark, f"{out}/batch=*/late=false", schema=stream.schema)
    flagged = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType()), T.StructField("late", T.BooleanType())])
    late = spark.read.option("basePath", out).schema(flagged).parquet(out).where("late")
    return in_time, late
