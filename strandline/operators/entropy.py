"""Methylation entropy of windows of n motif positions.

Windows start at every motif position that has n positions within ``span`` bases, found
in overlapping bins (no chromosome is sorted in one task).  Reads meet windows by an
equi-join on the position; a read counts only if its extent covers the window.  Patterns
are counted before they are gathered, so a window's list holds distinct patterns only.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.intervals import points_in

MAX_CODES = 9


def windows(positions: DataFrame, n: int = 4, span: int = 50, motif_length: int = 2, bin_size: int | None = None) -> DataFrame:
    """``positions``: distinct (chrom, strand, pos) of a motif.  Returns (chrom, strand,
    start, end, k, pos): the k-th position (from 0) of each window; ``end`` is the end of
    the last motif, within ``span`` of the start."""
    size = bin_size or max(10 * span, 1000)
    rows = positions.where("chrom is not null and pos is not null").select("chrom", "strand", "pos")
    # a position is also in the bin before its own if a window that starts there can reach it
    own = F.expr(f"pos div {size}")
    spread = rows.withColumn("own", own).withColumn("bin", F.explode(F.array_distinct(F.array(F.col("own"), F.expr(f"greatest(0, pos - {span}) div {size}")))))
    w = Window.partitionBy("chrom", "strand", "bin").orderBy("pos").rowsBetween(0, n - 1)
    wide = spread.withColumn("w", F.collect_list("pos").over(w)).where((F.col("own") == F.col("bin")) & (F.size("w") == n))
    end = F.element_at("w", -1) + motif_length
    return wide.where(end - F.col("pos") <= span).select("chrom", "strand", F.col("pos").alias("start"), end.alias("end"), F.posexplode("w").alias("k", "pos"))


def window_patterns(called: DataFrame, wins: DataFrame, extents: DataFrame, n: int = 4, max_filtered: int | None = None) -> DataFrame:
    """(chrom, strand, start, end, codes, n): how many reads show each sequence of codes
    (``-`` canonical, ``*`` filtered or missing) in each window.  Reads with more than
    ``max_filtered`` (default: half) of ``*`` are left out."""
    most = n // 2 if max_filtered is None else max_filtered
    state = F.when(F.col("call.kind") == "modified", F.col("call.code")).when(F.col("call.kind") == "canonical", "-")
    calls = called.where("call.kind in ('modified', 'canonical')").select("read_id", "flag", "chrom", "strand", F.col("ref_pos").alias("pos"), state.alias("state")).join(extents, ["read_id", "flag", "chrom"])
    hit = calls.join(wins, ["chrom", "strand", "pos"]).where("ref_start <= start and ref_end >= end")
    per_read = hit.groupBy("chrom", "strand", "start", "end", "read_id", "flag").agg(*[F.coalesce(F.max(F.when(F.col("k") == k, F.col("state"))), F.lit("*")).alias(f"s{k}") for k in range(n)])
    codes = F.array(*[F.col(f"s{k}") for k in range(n)])
    kept = per_read.withColumn("codes", codes).where(F.size(F.filter("codes", lambda c: c == "*")) <= most)
    return kept.groupBy("chrom", "strand", "start", "end", "codes").agg(F.count("*").alias("n"))


def expand(patterns: dict[str, float]) -> list[str]:
    """Every full pattern that the patterns together allow: a ``*`` stands for what is
    seen in its column, as far as an observed pattern leads there."""
    if not any("*" in p for p in patterns):
        return sorted(patterns)
    n = len(next(iter(patterns)))
    column = [sorted({p[i] for p in patterns} - {"*"}) for i in range(n)]
    found = set(column[0])
    for i in range(1, n):
        longer = set()
        for p in patterns:
            fits = _regex(p[:i], column)
            for f in found:
                if fits.fullmatch(f):
                    longer.update(f + x for x in (column[i] if p[i] == "*" else [p[i]]))
        found = longer
    return sorted(found)


def _regex(pattern: str, column: list[list[str]]) -> re.Pattern:
    return re.compile("".join("[" + "".join(column[i]) + "]" if c == "*" else c for i, c in enumerate(pattern)))


def entropy(patterns: dict[str, float]) -> float:
    """-(1/n) sum p log2 p over full patterns; a pattern with ``*`` counts in equal parts
    for every full pattern it fits.  ``patterns``: encoded pattern to reads."""
    full = expand(patterns)
    n = len(next(iter(patterns)))
    column = [sorted({p[i] for p in patterns} - {"*"}) for i in range(n)]
    count = dict.fromkeys(full, 0.0)
    for p, c in patterns.items():
        fits = _regex(p, column)
        own = [f for f in full if fits.fullmatch(f)]
        for f in own:
            count[f] += c / len(own)
    whole = sum(count.values())
    return -sum(c / whole * math.log2(c / whole) for c in count.values() if c) / n + 0.0


def encode(rows: list[tuple[list[str], int]]) -> dict[str, float]:
    """Codes as digits: canonical 0, modification codes 1 to 9 in order (ChEBI numbers first)."""
    codes = sorted({c for r, _ in rows for c in r} - {"-", "*"}, key=lambda c: (not c.isdigit(), int(c) if c.isdigit() else 0, c))
    if len(codes) > MAX_CODES:
        raise ValueError(f"a window has more than {MAX_CODES} modification codes")
    digit = {"-": "0", "*": "*", **{c: str(i) for i, c in enumerate(codes, 1)}}
    out: dict[str, float] = {}
    for r, n in rows:
        key = "".join(digit[c] for c in r)
        out[key] = out.get(key, 0) + n
    return out


def window_entropy(patterns: DataFrame, n: int = 4, min_coverage: int = 3) -> DataFrame:
    """(chrom, start, end, strand, entropy, num_reads) of windows all of whose positions
    have ``min_coverage`` calls; of others the entropy is null."""
    valid = [F.sum(F.when(F.col("codes")[k] != "*", F.col("n")).otherwise(0)).alias(f"v{k}") for k in range(n)]
    by = patterns.groupBy("chrom", "start", "end", "strand").agg(F.sum("n").alias("num_reads"), F.collect_list(F.struct("codes", "n")).alias("p"), *valid)
    enough = F.least(*[F.col(f"v{k}") for k in range(n)]) >= min_coverage if n > 1 else F.col("v0") >= min_coverage

    @F.pandas_udf("double")
    def run(codes: pd.Series, counts: pd.Series) -> pd.Series:
        memo: dict[tuple, float] = {}
        out = []
        for c, k in zip(codes, counts):
            e = encode([(list(x), int(y)) for x, y in zip(c, k)])
            key = tuple(sorted(e.items()))
            if key not in memo:
                memo[key] = entropy(e)
            out.append(memo[key])
        return pd.Series(out)

    scored = by.where(enough).withColumn("entropy", run(F.transform("p", lambda x: x["codes"]), F.transform("p", lambda x: x["n"])))
    short = by.where(~enough).withColumn("entropy", F.lit(None).cast("double"))
    return scored.unionByName(short).select("chrom", "start", "end", "strand", "entropy", "num_reads")


def region_entropy(wins: DataFrame, regions: DataFrame) -> DataFrame:
    """Entropy and reads of the windows that start in each region, by strand: mean,
    median (true median), least and most, and windows with and without an entropy."""
    rows = wins.withColumnRenamed("start", "wstart").withColumnRenamed("end", "wend")
    hit = points_in(rows, regions.select("chrom", "start", "end", "region_name", F.lit(".").alias("strand")), "wstart").where(F.col("wend") <= F.col("end"))
    ok = F.col("entropy").isNotNull()
    reads = F.when(ok, F.col("num_reads"))
    return hit.groupBy("chrom", "start", "end", "region_name", "strand").agg(
        F.avg("entropy").alias("mean_entropy"), F.percentile("entropy", F.lit(0.5)).alias("median_entropy"), F.min("entropy").alias("min_entropy"), F.max("entropy").alias("max_entropy"),
        F.avg(reads).alias("mean_num_reads"), F.min(reads).alias("min_num_reads"), F.max(reads).alias("max_num_reads"),
        F.sum(ok.cast("long")).alias("successful_window_count"), F.sum((~ok).cast("long")).alias("failed_window_count"),
    )
