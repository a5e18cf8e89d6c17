"""Running block maxima over arriving files (ST1).

Files landing in a folder are read as a stream; each micro-batch updates the
per-(key, window) maximum held in the streaming state, and its updated rows
are written to the folder of its epoch, which a replayed epoch overwrites.  Every so many epochs the
folders are merged into one compacted table with one row per key and window, and
removed when it is written.  ``max`` is idempotent, so a table that holds an epoch twice, after a failure between
the two steps, reads the same.  Late rows are bounded by the watermark.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvio.session import ensure_checkpoint_dir


def stream_block_maxima(
    spark: SparkSession,
    source_dir: str,
    key: str,
    ts: str,
    value: str,
    period: str = "1 day",
    late: str = "1 day",
    glob: str | None = None,
    out_dir: str | None = None,
    checkpoint: str | None = None,
    compact_every: int = 20,
) -> DataFrame:
    """Run the stream over everything available now and return the maxima.

    Give ``out_dir`` and a lasting ``checkpoint`` together: a later call then reads
    only the files that are new and adds their maxima.  Without them the call stands alone.
    The epochs are compacted after every ``compact_every`` of them and at the end.  One stream at a time
    may write to ``out_dir``.

    Output: (key, window_start, value) with one row per key and window.
    """
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    schema = reader.parquet(source_dir).schema
    base = ensure_checkpoint_dir(spark).rstrip("/")
    run = uuid.uuid4().hex[:12]
    out_dir = out_dir or f"{base}/blockmax-{run}"
    ckpt = checkpoint or f"{base}/blockmax-ckpt-{run}"

    src = spark.readStream.schema(schema)
    if glob:
        src = src.option("pathGlobFilter", glob)
    # Watermarks need TIMESTAMP.  A zone-less (NTZ) event time is read as a
    # UTC wall clock, so day windows line up with the data's own days whatever
    # the session time zone, and window starts are returned zone-less again.
    ntz = schema[ts].dataType.typeName() == "timestamp_ntz"
    tz = spark.conf.get("spark.sql.session.timeZone")
    event = F.from_utc_timestamp(F.col(ts).cast("timestamp"), tz) if ntz else F.col(ts)
    stream = src.parquet(source_dir).select(key, event.alias(ts), value)
    agg = (
        stream.withWatermark(ts, late)
        .groupBy(F.window(ts, period).alias("w"), key)
        .agg(F.max(value).alias(value))
    )

    start = F.to_utc_timestamp(F.col("w.start"), tz).cast("timestamp_ntz") if ntz else F.col("w.start")

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch.select(key, start.alias("window_start"), value)
        rows.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/epoch={epoch}")
        if (epoch + 1) % compact_every == 0:
            compact_block_maxima(batch.sparkSession, out_dir, key, value)

    # what an earlier stream left, whose epochs this one could number alike
    compact_block_maxima(spark, out_dir, key, value)

    q = (
        agg.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", ckpt)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    compact_block_maxima(spark, out_dir, key, value)
    tables = _tables(spark, out_dir)
    if not tables:  # nothing has arrived yet
        kinds = f"`{key}` {schema[key].dataType.simpleString()}, window_start {'timestamp_ntz' if ntz else 'timestamp'}, `{value}` {schema[value].dataType.simpleString()}"
        return spark.createDataFrame([], kinds)
    return read_block_maxima(spark, out_dir, key, value)


def _tables(spark: SparkSession, out_dir: str) -> list[str]:
    """The completely written tables under ``out_dir``: epochs and compacted ones."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [f.getPath() for f in fs.listStatus(path) if f.isDirectory()]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(p.toString() for p in found if fs.exists(done(p, "_SUCCESS")))


def compact_block_maxima(spark: SparkSession, out_dir: str, key: str, value: str) -> None:
    """Merge all tables under ``out_dir`` into one, with one row per key and window; they are removed
    once it is written.  A failure before that leaves them as they were."""
    tables = _tables(spark, out_dir)
    if len(tables) < 2 and not any("/epoch=" in t for t in tables):
        return
    merged = spark.read.parquet(*tables).groupBy(key, "window_start").agg(F.max(value).alias(value))
    merged.write.parquet(f"{out_dir.rstrip('/')}/compacted-{uuid.uuid4().hex[:12]}")
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_block_maxima(spark: SparkSession, out_dir: str, key: str, value: str) -> DataFrame:
    """Final maxima of all tables written so far (max per key and window)."""
    return spark.read.parquet(*_tables(spark, out_dir)).groupBy(key, "window_start").agg(F.max(value).alias(value))
