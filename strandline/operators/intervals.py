"""Joins of positions and intervals, half-open, on the (chrom, bin) equality.

Intervals are spread over the bins they touch, points lie in one bin, so the join is a
hash join with a residual range condition; a hot chromosome is spread over its bins.
Null chrom or bounds match nothing; empty intervals match nothing; repeated intervals
match repeatedly (``semi`` and ``anti`` are not affected).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 100_000


def _bins(intervals: DataFrame, start: str, end: str, size: int) -> DataFrame:
    ok = intervals.where(F.col(start).isNotNull() & (F.col(end) > F.col(start)))
    first, last = F.expr(f"`{start}` div {size}"), F.expr(f"(`{end}` - 1) div {size}")
    return ok.withColumn("_bin", F.explode(F.sequence(first, last)))


def points_in(points: DataFrame, intervals: DataFrame, pos: str, how: str = "inner", strand: str | None = None, size: int = BIN, start: str = "start", end: str = "end") -> DataFrame:
    """Points with ``start <= pos < end`` of an interval of the same chrom.

    ``intervals``: chrom, start, end and more; with ``strand`` (a column of ``points``)
    an interval of strand ``.`` covers both strands, others their own.  For ``inner`` the
    other interval columns must not clash with those of ``points``."""
    r = _bins(intervals, start, end, size).withColumnRenamed("chrom", "_chrom").withColumnRenamed("strand", "_strand").alias("r")
    p = points.withColumn("_pbin", F.expr(f"`{pos}` div {size}")).alias("p")
    on = (F.col("p.chrom") == F.col("r._chrom")) & (F.col("p._pbin") == F.col("r._bin")) & (F.col(f"p.{pos}") >= F.col(f"r.{start}")) & (F.col(f"p.{pos}") < F.col(f"r.{end}"))
    if strand:
        on &= (F.col("r._strand") == ".") | (F.col(f"p.{strand}") == ".") | (F.col(f"p.{strand}") == F.col("r._strand"))
    out = p.join(r, on, {"inner": "inner", "semi": "left_semi", "anti": "left_anti"}[how]).drop("_pbin")
    return out.drop("_bin", "_chrom", *(["_strand"] if how == "inner" else []))


def containing(reads: DataFrame, windows: DataFrame, size: int = BIN) -> DataFrame:
    """Reads (chrom, ref_start, ref_end) with every window (chrom, start, end) they fully
    cover; matched in the bin of the window's start."""
    r = _bins(reads, "ref_start", "ref_end", size).withColumnRenamed("chrom", "_chrom").alias("r")
    w = windows.where("end > start").withColumn("_wbin", F.expr(f"start div {size}")).alias("w")
    on = (F.col("w.chrom") == F.col("r._chrom")) & (F.col("w._wbin") == F.col("r._bin")) & (F.col("r.ref_start") <= F.col("w.start")) & (F.col("r.ref_end") >= F.col("w.end"))
    return w.join(r, on).drop("_wbin", "_bin", "_chrom")


def merge(intervals: DataFrame, by: tuple[str, ...] = ("chrom",), size: int = BIN) -> DataFrame:
    """Overlapping or touching intervals of a group as one.

    Intervals are ordered within bins of their start; how far earlier bins reach, and how
    many merged intervals begin in them, is carried over from one row per bin, so no
    chromosome is sorted in one task."""
    rows = intervals.where("chrom is not null and start is not null and end > start").withColumn("_bin", F.expr(f"start div {size}"))
    before = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    reach = rows.groupBy(*by, "_bin").agg(F.max("end").alias("_e")).withColumn("_reach", F.max("_e").over(before)).drop("_e")
    w = Window.partitionBy(*by, "_bin").orderBy("start", "end")
    inside = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    so_far = F.greatest("_reach", inside)  # null only where both are
    marked = rows.join(reach, [*by, "_bin"]).withColumn("_new", F.coalesce((F.col("start") > so_far).cast("long"), F.lit(1)))
    begun = marked.groupBy(*by, "_bin").agg(F.sum("_new").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    # by range: equal intervals are in one run, whichever of them began it
    numbered = marked.join(begun, [*by, "_bin"]).withColumn("_run", F.col("_base") + F.sum("_new").over(w))
    return numbered.groupBy(*by, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_run")


def midpoint(start: Column, end: Column) -> Column:
    return F.floor((start + end) / 2).cast("long")
