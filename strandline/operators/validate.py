"""Calls against ground truth: confusion matrix, balancing, thresholds and accuracy."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import probs as P
from strandline.functions.seq import cigar_sum, query_position
from strandline.operators.intervals import points_in
from strandline.schema import complement


def against_truth(pos: DataFrame, truth: DataFrame) -> DataFrame:
    """(truth, call, p): the most probable class of each position inside a truth
    interval (chrom, start, end, strand, code; ``-`` is canonical).  Positions without
    probabilities are ``no_call``."""
    hit = points_in(pos.where("chrom is not null"), truth.select("chrom", "start", "end", "strand", F.col("code").alias("truth")), "ref_pos", "inner", "strand")
    top = P.argmax_call(F.col("probs"))
    called = F.col("kind") == "call"
    return hit.select("truth", F.when(called, F.coalesce(top["code"], F.lit("-"))).otherwise("no_call").alias("call"), F.when(called, top["p"]).alias("p"))


def uncalled(reads: DataFrame, calls: DataFrame, truth: DataFrame, base: str = "C") -> DataFrame:
    """(read_id, flag, truth, status): truth positions (chrom, pos, strand, code) inside
    the alignments of ``reads`` for which the read has no row in ``calls`` (read_id, flag,
    chrom, ref_pos, strand), on strands where it has any: ``deletion`` where its
    alignment has a gap, ``no_call`` where it has ``base`` on that strand, else
    ``mismatch X`` with what it has instead."""
    rows = reads.where("chrom is not null and pos >= 0 and cigar is not null and seq is not null").where(F.col("flag").bitwiseAND(4) == 0)
    rows = rows.select("read_id", "flag", F.col("chrom").alias("read_chrom"), "pos", "cigar", "seq", F.col("pos").alias("start"), (F.col("pos") + cigar_sum(F.col("cigar"), "M=XDN")).alias("end"))
    points = truth.select("chrom", F.col("pos").alias("truth_pos"), F.col("strand").alias("truth_strand"), F.col("code").alias("truth"))
    met = points_in(points, rows.withColumnRenamed("read_chrom", "chrom"), "truth_pos")
    strands = calls.select("read_id", "flag", F.col("strand").alias("truth_strand")).distinct()
    met = met.join(strands, ["read_id", "flag", "truth_strand"], "left_semi")
    done = calls.select("read_id", "flag", "chrom", F.col("ref_pos").alias("truth_pos"), F.col("strand").alias("truth_strand")).distinct()
    left = met.join(done, ["read_id", "flag", "chrom", "truth_pos", "truth_strand"], "left_anti")

    @F.pandas_udf("string")
    def shown(seq: pd.Series, cigar: pd.Series, pos: pd.Series, at: pd.Series) -> pd.Series:
        """The stored sequence's base at a reference position; empty in a gap."""
        out = []
        for s, c, p, x in zip(seq, cigar, pos, at):
            q = query_position(c, int(p), int(x))
            out.append("" if q is None else s[q : q + 1].upper())
        return pd.Series(out, dtype=object)

    seen = shown("seq", "cigar", "pos", "truth_pos")
    own = left.withColumn("_seen", seen).withColumn("_own", F.when(F.col("truth_strand") == "-", complement(F.col("_seen"))).otherwise(F.col("_seen")))
    status = F.when(F.col("_seen") == "", "deletion").when(F.col("_own") == base, "no_call").otherwise(F.concat(F.lit("mismatch "), F.col("_own")))
    return own.select("read_id", "flag", "truth", status.alias("status"))


def confusion(rows: DataFrame) -> DataFrame:
    """Counts and the percentage of each call among the rows of its truth."""
    by = rows.groupBy("truth", "call").agg(F.count("*").alias("n"))
    return by.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("truth")))


def balance(rows: DataFrame) -> DataFrame:
    """As many rows of each truth as the rarest has, evenly spaced over the sorted
    probabilities.  Rows are counted by value, so ranks come from sums over the distinct
    values, not from sorting a truth's rows in one task.  Adds ``c``: how many rows like this."""
    scored = rows.where("call <> 'no_call'").groupBy("truth", "call", "p").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("truth").orderBy("p", "call"))
    total = F.sum("c").over(Window.partitionBy("truth"))
    ranked = scored.withColumn("upto", upto).withColumn("total", total)
    least = F.min("total").over(Window.partitionBy())
    # row i of the sample is at rank floor((i + 1) total / (least + 1)): interior points, evenly spaced
    below = lambda r: F.greatest(F.lit(0), F.floor(((r * (F.col("least") + 1)).cast("double") - 1) / F.col("total"))).cast("long")
    picked = ranked.withColumn("least", least)
    n = F.least(F.col("least"), below(F.col("upto"))) - F.least(F.col("least"), below(F.col("upto") - F.col("c")))
    return picked.withColumn("c", F.when(F.col("total") == F.col("least"), F.col("c")).otherwise(F.greatest(F.lit(0), n))).where("c > 0").select("truth", "call", "p", "c")


def accuracy(balanced: DataFrame, quantile: float = 0.1) -> DataFrame:
    """Raw accuracy; the threshold (a percentile of p, less half a probability bin); and
    the accuracy of rows above it, in percent."""
    t = balanced.agg(F.percentile("p", F.lit(quantile), F.col("c")).alias("v"))
    rows = balanced.join(F.broadcast(t)).withColumn("threshold", F.col("v") - 1 / 512)
    right, kept = F.col("truth") == F.col("call"), F.col("p") > F.col("threshold")
    n = lambda c: F.sum(F.when(c, F.col("c")).otherwise(0))
    share = lambda a, b: F.try_divide(100.0 * a, b.cast("double"))
    return rows.agg(F.sum("c").alias("n"), share(n(right), F.sum("c")).alias("raw_accuracy"), F.max("threshold").alias("threshold"), n(kept).alias("n_kept"), share(n(right & kept), n(kept)).alias("filtered_accuracy"))
