"""Incremental ingest with Structured Streaming: exact copies once, sessions with late rows, parked arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keepstone.streaming.contents import ContentStore


def stream_table(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A table (a file or a folder of files) as a stream, so many files a trigger.

    The source takes a plain path for a folder; a pattern that matches the path alone stands for either.
    """
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)


def store_new(stream: DataFrame, key: list[str], sink: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet table what it doesn't hold yet, each key once: a copy is a copy however late it comes.

    What is stored is the state, so nothing grows in memory, and a batch reads only what its own keys reach (see
    ``contents``). A batch that runs again replaces its own part.
    """

    def handle(batch: DataFrame, number: int) -> None:
        fresh = ContentStore(batch.sparkSession, f"{sink}-keys", key).add(batch, number)
        fresh.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return each_batch(stream, handle, checkpoint)


def run_latest(counts: DataFrame, key: list[str], sink: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest row of each key of an updating aggregate in a Parquet table; tables take turns, so a batch never
    reads what it writes."""

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        here, other = f"{sink}-{number % 2}", f"{sink}-{(number + 1) % 2}"
        rows = batch
        if number:
            rows = spark.read.schema(batch.schema).parquet(other).join(batch.select(*key), key, "left_anti").unionByName(batch)
        rows.write.mode("overwrite").parquet(here)
        spark.read.schema(batch.schema).parquet(here).write.mode("overwrite").parquet(sink)

    query = counts.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def first_of_content(stream: DataFrame, time: str, late: str, key: str = "sha256") -> DataFrame:
    """Each content once; state of contents older than the watermark is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def stream_sessions(stream: DataFrame, time: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Sessions by gap; a session is given out once the watermark has passed its end. The end is the last row's time."""
    rows = stream.withWatermark(time, late)
    grouped = rows.groupBy(F.session_window(time, gap).alias("w"), *keys)
    return grouped.agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n")).drop("w")


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str, slide: str, late: str) -> DataFrame:
    rows = stream.withWatermark(time, late)
    return rows.groupBy(F.window(time, width, slide).alias("w"), *keys).agg(F.count("*").alias("n")).select("w.start", "w.end", *keys, "n")


def run_available(df: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there into Parquet and stop; a later call goes on from the checkpoint."""
    query = df.writeStream.outputMode(mode).format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def settle(batch: DataFrame, pending: DataFrame, now: float, seconds: float) -> tuple[DataFrame, DataFrame]:
    """(ready, pending): files that changed too recently wait and are offered again; of a path the newest row counts."""
    from pyspark.sql import Window

    order = Window.partitionBy("path").orderBy(F.desc("mtime"), F.desc("size"))
    newest = batch.unionByName(pending).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    calm = F.lit(now) - F.col("mtime") >= seconds
    return newest.where(calm), newest.where(~calm)


def touched(records: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Rows of the groups that a change touches; null scope means all rows."""
    return records if changed is None else records.join(changed.select(key).distinct(), key, "left_semi")


def each_batch(stream: DataFrame, handle, checkpoint: str) -> StreamingQuery:
    """Run a function (batch, number) for each micro-batch of what is there, exactly once for each number."""
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
