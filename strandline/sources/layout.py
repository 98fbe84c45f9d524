"""Tables laid out by (chrom, bin), and the fetch of a region that reads only its files.

``write`` makes a folder per chrom and bin of the start; an interval that reaches into
later bins lies in the folder of its ``reach`` (bins it crosses, rounded up to a power of
two), so a fetch knows how far before a region intervals may begin.  ``fetch`` asks for
the folders of the region's bins, which Spark prunes before it lists or reads a file, and
compares positions in the rest.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Positions of a bin: a folder holds about as many rows as a large file of a pileup.
BIN = 1 << 22


@dataclass(frozen=True)
class Region:
    """``chrom`` from ``start`` up to ``end``, half-open."""

    chrom: str
    start: int
    end: int


def parse_region(text: str, sizes: dict[str, int]) -> Region:
    """``chrom:start-end`` (thousands may be parted by commas) or the whole of a ``chrom``
    that ``sizes`` names.  Anything else is a ``ValueError``."""
    if ":" not in text:
        if text not in sizes:
            raise ValueError(f"no such contig: {text}")
        return Region(text, 0, sizes[text])
    chrom, _, span = text.partition(":")
    m = re.fullmatch(r"([0-9][0-9,]*)-([0-9][0-9,]*)", span, re.ASCII)
    start, end = (int(x.replace(",", "")) for x in m.groups()) if m else (0, 0)
    if not m or end <= start or end >= 1 << 32:
        raise ValueError(f"not a region: {text}")
    return Region(chrom, start, end)


def _reach(first: Column, last: Column) -> Column:
    """Bins crossed, rounded up to 0, 1, 2, 4, 8, ..."""
    crossed = last - first
    return F.when(crossed <= 0, 0).otherwise(F.pow(2, F.ceil(F.log2(crossed.cast("double")) - 1e-9))).cast("long")


def write(rows: DataFrame, path: str, start: str, end: str | None = None, size: int = BIN, force: bool = False) -> None:
    """``rows`` by chrom and bin, sorted by start within a file.  Rows without chrom or
    start are left out.  One shuffle, by (chrom, bin): a large chrom is spread over its bins."""
    ok = rows.where(F.col("chrom").isNotNull() & F.col(start).isNotNull())
    first = F.expr(f"`{start}` div {size}")
    last = F.expr(f"greatest(`{start}`, `{end}` - 1) div {size}") if end else first
    laid = ok.withColumn("_bin", first).withColumn("_reach", _reach(first, last)).withColumn("_chrom", F.col("chrom"))
    laid.repartition("_chrom", "_bin").sortWithinPartitions("_chrom", "_reach", "_bin", start).write.mode("overwrite" if force else "error").partitionBy("_chrom", "_reach", "_bin").parquet(path)


def fetch(spark: SparkSession, path: str, regions: list[Region], start: str, end: str | None = None, size: int = BIN) -> DataFrame:
    """Rows that overlap one of the regions, each once."""
    rows = spark.read.option("recursiveFileLookup", "false").parquet(path)
    shape = {f.name: f.dataType.simpleString() for f in rows.schema}
    if "_reach" not in shape:
        raise ValueError(f"not laid out by (chrom, bin): {path}")
    steps = [0, *(1 << k for k in range(32))]
    inside = F.lit(False)
    for r in regions:
        first, last = r.start // size, (r.end - 1) // size
        near = reduce(lambda a, b: a | b, ((F.col("_reach") == s) & (F.col("_bin") >= first - s) & (F.col("_bin") <= last) for s in (steps if end else steps[:1])))
        inside |= (F.col("_chrom") == r.chrom) & near & (F.col(start) < r.end) & (F.col(end if end else start) > (r.start if end else r.start - 1))
    return rows.where(inside).drop("_chrom", "_reach", "_bin")
