"""Pass thresholds, probability histograms, summaries and quota samples.

Percentiles interpolate linearly at (n − 1) q.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import probs as P
from strandline.operators.calls import called
from strandline.session import materialize


def top_probabilities(pos: DataFrame) -> DataFrame:
    """(base, p): the probability of the most probable class of each position."""
    return pos.where("kind = 'call'").select("base", P.argmax_call(F.col("probs"))["p"].alias("p"))


#: Bins of probabilities that are counted before values are looked at.
BINS = 1 << 16


def base_percentiles(pos: DataFrame, qs: list[float]) -> DataFrame:
    """Percentiles of the top probabilities of each base; a base with one position has none.

    Values are counted, and the counts summed in ``BINS`` bins; only the values of the bins
    that hold a wanted rank are then sorted, each bin on its own."""
    bin_ = F.floor(F.col("p") * BINS).alias("b")
    counted = materialize(top_probabilities(pos).groupBy("base", "p", bin_).agg(F.count("*").alias("c")))
    upto = F.sum("c").over(Window.partitionBy("base").orderBy("b"))  # BINS rows at most
    bins = counted.groupBy("base", "b").agg(F.sum("c").alias("c")).select("base", "b", (upto - F.col("c")).alias("low"), upto.alias("high"))
    q = F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q")
    spots = counted.groupBy("base").agg(F.sum("c").alias("n")).where("n >= 2").select("base", "n", q).withColumn("spot", (F.col("n") - 1) * F.col("q"))
    ranks = spots.select("*", F.explode(F.array(F.floor("spot"), F.ceil("spot"))).alias("rank"))
    near = F.broadcast(ranks).join(bins, "base").where("rank >= low and rank < high").select("base", "n", "q", "spot", "rank", "b", "low").distinct()  # two for each base and q
    inside = F.sum("c").over(Window.partitionBy("base", "b").orderBy("p"))
    values = counted.join(F.broadcast(near.select("base", "b", "low").distinct()), ["base", "b"]).withColumn("upto", F.col("low") + inside)
    hit = values.drop("low").join(F.broadcast(near), ["base", "b"]).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
    both = hit.groupBy("base", "n", "q", "spot").agg(F.min("p").alias("x"), F.max("p").alias("y"))
    # exact where both neighbours are equal
    return both.select("base", "n", "q", (F.col("x") + (F.col("y") - F.col("x")) * (F.col("spot") - F.floor("spot"))).alias("value"))


def estimate_thresholds(pos: DataFrame, q: float = 0.1) -> P.Thresholds:
    """The pass threshold of each base: a percentile of its top probabilities (four rows at most)."""
    return P.Thresholds(0.0, {r["base"]: r["value"] for r in base_percentiles(pos, [q]).collect()})


def histogram(pos: DataFrame) -> DataFrame:
    """(base, code, qual): how many positions have that code at that probability bin, the
    fraction of the code's positions, and the mid-rank percentile of the bin."""
    rows = pos.where("kind = 'call'").select("base", F.explode("probs").alias("code", "p"))
    binned = rows.groupBy("base", "code", P.prob_to_qual(F.col("p")).alias("qual")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("base", "code")
    run = F.sum("n").over(w.orderBy("qual"))
    total = F.sum("n").over(w)
    return binned.select("base", "code", "qual", "n", (F.col("n") / total).alias("frac"), ((run - F.col("n") / 2.0) / total).alias("percentile"))


def summary(pos: DataFrame, thresholds: P.Thresholds) -> DataFrame:
    """For each base and class (``-`` is canonical): positions that pass with it, fail
    with it as the most probable class, both, their fractions of the base, and reads."""
    rows = called(pos.where("kind = 'call'"), thresholds).withColumn("top", P.argmax_call(F.col("probs")))
    passed = F.col("call.kind") != "filtered"
    code = F.coalesce(F.when(passed, F.col("call.code")).otherwise(F.col("top.code")), F.lit("-"))
    by = rows.groupBy("base", code.alias("code")).agg(F.sum(passed.cast("long")).alias("pass_count"), F.count("*").alias("all_count"))
    reads = rows.groupBy("base", "read_id").count().groupBy("base").agg(F.count("*").alias("reads"))
    w = Window.partitionBy("base")
    frac = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.sum(c).over(w).cast("double")), F.lit(0.0))
    out = by.select("base", "code", "pass_count", (F.col("all_count") - F.col("pass_count")).alias("fail_count"), "all_count", frac("pass_count").alias("pass_frac"), frac("all_count").alias("all_frac"))
    return out.join(reads, "base")


def sample_fraction(reads: DataFrame, fraction: float, seed: int = 0, key: str = "read_id") -> DataFrame:
    """About ``fraction`` of the reads, the same in every run; null keys are left out."""
    if not 0 <= fraction <= 1:
        raise ValueError("a fraction is from 0 to 1")
    return reads.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < int(fraction * 1_000_000)))


def first_reads(reads: DataFrame, n: int) -> DataFrame:
    """Any ``n`` reads, as they come (the limit is the feature)."""
    return reads.limit(n)


def contig_quotas(reads: DataFrame, n_target: int, most: float = 1.5) -> DataFrame:
    """(chrom, n, quota): reads wanted of each contig, in proportion, rounded up.

    Rounding up gives many small contigs a read each; while the quotas add up to more than
    ``most`` times the target, contigs with the smallest quotas are left out (quota 0),
    ties by name: until a quota's contigs are all out and the sum is small enough, or
    until the target is met."""
    by = reads.where("chrom is not null").groupBy("chrom").agg(F.count("*").alias("n"))
    whole = F.broadcast(by.agg(F.sum("n").alias("_whole")))
    quota = F.least(F.col("n"), F.ceil(F.col("n") * (F.lit(float(n_target)) / F.col("_whole")) - 1e-9)).cast("long")
    wanted = by.join(whole).withColumn("quota", quota).drop("_whole")
    # what is left when a contig's turn comes, and when its quota's turn comes; one row per contig
    total = F.broadcast(wanted.agg(F.sum("quota").alias("_total")))
    before = lambda *o: Window.orderBy(*o)
    ranked = wanted.join(total).withColumn("_upto", F.sum("quota").over(before("quota", "chrom").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = ranked.withColumn("_level", F.sum("quota").over(before("quota").rangeBetween(Window.unboundedPreceding, -1)))
    left = lambda c: F.col("_total") - F.coalesce(F.col(c), F.lit(0))
    out = (F.col("_total") > most * n_target) & (left("_upto") > n_target) & (left("_level") > most * n_target)
    return ranked.select("chrom", "n", F.when(out, F.lit(0)).otherwise(F.col("quota")).cast("long").alias("quota"))


def sample_even(reads: DataFrame, n_target: int, bins: int = 64) -> DataFrame:
    """A sample spread along the contigs: every contig gets its quota, every bin of it a
    share in proportion to its length, the first reads of each bin by a hash of the id.
    Reads are ranked within bins, so no contig is ranked in one task."""
    sized = contig_quotas(reads, n_target)
    extent = reads.where("chrom is not null").groupBy("chrom").agg(F.min("ref_start").alias("lo"), F.max("ref_start").alias("hi"))
    plan = sized.join(extent, "chrom")
    share = F.ceil(F.col("quota") / F.lit(float(bins)) - 1e-9)
    width = F.greatest(F.lit(1.0), (F.col("hi") - F.col("lo") + 1) / F.lit(float(bins)))
    rows = reads.join(F.broadcast(plan), "chrom").withColumn("bin", F.floor((F.col("ref_start") - F.col("lo")) / width).cast("int"))
    w = Window.partitionBy("chrom", "bin").orderBy(F.md5("read_id"), "read_id", "flag")
    return rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= share).select("read_id", "flag", "chrom", "ref_start", "bin")
