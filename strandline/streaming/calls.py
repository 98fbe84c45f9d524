"""Streams of read-level rows and of tagged reads.

The record-by-record operators (decode, adjust, call, extract) need no state and run as
streams.  Thresholds must be given: they can't be estimated from a stream that has not
ended.  Tallies are keyed aggregations with a watermark on the time rows were loaded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from strandline.functions import probs as P
from strandline.functions.tags import decode_reads, repair
from strandline.operators import tables
from strandline.session import usable


def read_rows(spark: SparkSession, path: str, schema=None, max_files: int = 100) -> DataFrame:
    """A stream over the parquet files of a folder, or over a single file."""
    source = spark.readStream.schema(schema or spark.read.parquet(path).schema).option("maxFilesPerTrigger", max_files)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return source.option("pathGlobFilter", at.getName()).parquet(str(at.getParent()))
    return source.parquet(path)


def decoded(reads: DataFrame) -> DataFrame:
    """Tagged reads to one row per position (see ``functions.tags.decode_reads``)."""
    return decode_reads(reads)


def repaired(acceptors: DataFrame, donors: DataFrame) -> DataFrame:
    """A stream of trimmed reads that get the tags of a static table of whole ones."""
    return repair(donors, acceptors)


def pass_rows(rows: DataFrame, thresholds: P.Thresholds | None, prob: str = "mod_qual", code: str = "mod_code", base: str = "canonical_base") -> DataFrame:
    """Rows of (position, code) with ``passes``: whether the probability reaches the code's threshold."""
    if thresholds is None:
        raise ValueError("a stream needs given thresholds")
    ok = usable(F.col(prob), 0, 1)
    return rows.withColumn("passes", F.coalesce(ok & (F.col(prob).cast("double") >= thresholds.of_code(F.col(code), F.col(base))), F.lit(False)))


def windowed_counts(rows: DataFrame, thresholds: P.Thresholds, time: str = "loaded_at", window: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Rows and passing rows by window of loading time, contig and code; rows later than
    ``delay`` behind the newest are dropped, as the watermark says."""
    marked = pass_rows(rows, thresholds).withWatermark(time, delay)
    return marked.groupBy(F.window(time, window).alias("w"), "chrom", F.col("mod_code").alias("code")).agg(F.count("*").alias("n"), F.sum(F.col("passes").cast("long")).alias("n_pass")).select(F.col("w.start").alias("from_time"), "chrom", "code", "n", "n_pass")


def track(rows: DataFrame, codes: list[str]) -> DataFrame:
    """A stream of pileup rows as a track (``operators.tables.track``): the state is one
    row per position, so it has no need of an order.  Written in complete mode."""
    return tables.track(rows, codes)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes what there is now to a parquet folder and stops.  In complete mode the folder
    holds the last result."""
    if mode == "complete":
        put = lambda batch, _: batch.write.mode("overwrite").parquet(path)
        stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return
    writer: DataStreamWriter = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.start(path).awaitTermination()
