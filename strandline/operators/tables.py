"""Operators on pileup tables (lower- or mixed-case column names): merge, region totals,
profiles around features, and a signed track."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.intervals import midpoint, points_in
from strandline.schema import COUNT_COLUMNS


def plain_code(bed: DataFrame) -> DataFrame:
    """Adds ``code``: the name without motif and offset."""
    return bed.withColumn("code", F.split("name", ",")[0])


def merge(bed: DataFrame) -> DataFrame:
    """Tables put together: the counts of each (chrom, start, name, strand) add up, and
    coverage and percentage follow from the sums.  Null counts add nothing; rows without
    chrom, start, name or strand are left out; repeated rows add up, as in any union."""
    rows = bed.where("chrom is not null and chromstart is not null and name is not null and strand is not null")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNT_COLUMNS]
    out = rows.groupBy("chrom", "chromstart", "name", "strand").agg(*sums)
    valid = F.col("count_modified") + F.col("count_canonical") + F.col("count_other_mod")
    return out.withColumn("valid_coverage", valid).withColumn("percent_modified", F.round(F.coalesce(F.try_divide(100.0 * F.col("count_modified"), valid.cast("double")), F.lit(0.0)), 2))


def region_stats(bed: DataFrame, regions: DataFrame, codes: list[str], min_coverage: int = 1) -> DataFrame:
    """One row per region (start, end, region_name, strand): for each code the modified
    and valid counts inside and their percentage (null without coverage).  Regions
    without rows are left out."""
    rows = plain_code(bed).where((F.col("valid_coverage") >= min_coverage) & F.col("code").isin(codes))
    hit = points_in(rows.select("chrom", "chromstart", "strand", "code", "count_modified", "valid_coverage"), regions.withColumn("region_strand", F.col("strand")), "chromstart", "inner", "strand")
    n = lambda code, c: F.sum(F.when(F.col("code") == code, F.col(c)).otherwise(0)).alias(f"{'count' if c == 'count_modified' else 'count_valid'}_{code}")
    out = hit.groupBy("chrom", "start", "end", "region_name", "region_strand").agg(*[n(code, c) for code in codes for c in ("count_modified", "valid_coverage")])
    for code in codes:
        out = out.withColumn(f"percent_{code}", F.round(F.try_divide(100.0 * F.col(f"count_{code}"), F.col(f"count_valid_{code}").cast("double")), 2))
    return out


def localize(bed: DataFrame, features: DataFrame, sizes: DataFrame, window: int = 2000, stranded: bool = True) -> DataFrame:
    """Counts by code and offset (midpoint of the feature minus position), from one base
    more than ``window`` before the midpoint up to ``window`` after it."""
    mid = midpoint(F.col("start"), F.col("end"))
    slices = (
        features.join(F.broadcast(sizes), "chrom")
        .select("chrom", mid.alias("mid"), "strand", "size")
        .select("chrom", "mid", "strand", F.greatest(F.lit(0), F.col("mid") - window - 1).alias("start"), F.least(F.col("mid") + window, F.col("size")).alias("end"))
    )
    rows = plain_code(bed).select("chrom", "chromstart", "strand", "code", "count_modified", "valid_coverage")
    hit = points_in(rows, slices, "chromstart", "inner", "strand" if stranded else None)
    return hit.groupBy("code", (F.col("mid") - F.col("chromstart")).alias("offset")).agg(F.sum("count_modified").alias("n_mod"), F.sum("valid_coverage").alias("n_valid")).withColumn("percent", F.round(F.try_divide(100.0 * F.col("n_mod"), F.col("n_valid").cast("double")), 2))


def track(bed: DataFrame, codes: list[str]) -> DataFrame:
    """One value per position: modified counts of ``codes`` add up on each strand, of two
    strands the one with more coverage is shown (a tie: +), − as a negative percentage."""
    rows = plain_code(bed).where(F.col("code").isin(codes) & F.col("chrom").isNotNull() & (F.col("valid_coverage") > 0))
    # one aggregation with a slot for each strand, so that it runs on a stream too
    sides = {"p": "+", "m": "-", "u": "."}
    own = lambda s, c: F.when(F.col("strand") == s, F.col(c))
    sums = [x for k, s in sides.items() for x in (F.sum(own(s, "count_modified")).alias(f"n_{k}"), F.max(own(s, "valid_coverage")).alias(f"cov_{k}"))]
    by = rows.where(F.col("strand").isin(*sides.values())).groupBy("chrom", "chromstart").agg(*sums)
    sign = {"p": 1.0, "m": -1.0, "u": 1.0}
    # of equal coverage the strand that comes first
    best = F.array_max(F.array(*[F.when(F.col(f"cov_{k}").isNotNull(), F.struct(F.col(f"cov_{k}").alias("cov"), F.lit(-i).alias("o"), F.col(f"n_{k}").alias("n"), F.lit(sign[k]).alias("sign"))) for i, k in enumerate(sides)]))
    return by.withColumn("b", best).select("chrom", F.col("chromstart").alias("start"), (F.col("chromstart") + 1).alias("end"), (F.round(F.col("b.sign") * 100.0 * F.least(F.lit(1.0), F.col("b.n") / F.col("b.cov")), 4) + 0.0).alias("value"))
