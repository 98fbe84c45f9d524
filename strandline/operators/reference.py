"""Operators that need the reference: focus positions, base positions, contig checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.seq import Motif
from strandline.operators.motifs import motif_hits
from strandline.schema import BASE_OF_CODE, COMPLEMENT, base_of_code


def focus(pos: DataFrame, hits: DataFrame) -> DataFrame:
    """Positions that are motif hits (chrom, motif, offset, pos, strand) of their strand.

    Adds ``motif_label``: null with one motif, else ``motif,offset``; a position that
    several motifs share is there once for each."""
    several = hits.select("motif", "offset").distinct().limit(2).count() > 1
    label = F.concat_ws(",", "motif", "offset") if several else F.lit(None).cast("string")
    marks = hits.select("chrom", F.col("pos").alias("ref_pos"), "strand", label.alias("motif_label")).distinct()
    return pos.join(marks, ["chrom", "ref_pos", "strand"])


def read_motif(pos: DataFrame, motif: Motif, keep: bool = True) -> DataFrame:
    """Keeps or discards positions whose read k-mer shows the motif at the position.  The
    k-mer is centred; one that is too short, or padded within the motif, does not show it."""
    size = F.length("query_kmer")
    start = F.floor(size / 2).cast("int") - motif.offset
    shown = (start >= 0) & F.substring("query_kmer", start + 1, F.lit(motif.length)).rlike(f"^{motif.pattern}$")
    shown = F.coalesce(shown, F.lit(False))
    return pos.where(shown if keep else ~shown)


def base_positions(reference: DataFrame, bases: list[str]) -> DataFrame:
    """(chrom, pos, strand, base) of every requested base on either strand.  If a base
    and its complement are both requested, such positions count on + only."""
    both = {b for b in bases if COMPLEMENT[b] in bases}
    hits = motif_hits(reference, [Motif(b, 0) for b in bases]).select("chrom", "pos", "strand", F.col("motif").alias("base"))
    return hits.where(~(F.col("base").isin(*both) & (F.col("strand") == "-"))) if both else hits


def at_reference_bases(bed: DataFrame, positions: DataFrame, code: str = "code", pos: str = "chromstart") -> DataFrame:
    """Rows of a pileup table whose position is a requested base: of strand ``.`` or +
    the base of the code at +, of strand − the code's base at −."""
    strand = F.when(F.col("strand") == "-", "-").otherwise("+")
    rows = bed.withColumn("_strand", strand).withColumn("_base", base_of_code(F.col(code)))
    known = positions.select(F.col("chrom").alias("_c"), F.col("pos").alias("_p"), F.col("strand").alias("_s"), F.col("base").alias("_b"))
    on = (F.col("chrom") == F.col("_c")) & (F.col(pos) == F.col("_p")) & (F.col("_strand") == F.col("_s")) & (F.col("_base") == F.col("_b"))
    return rows.join(known, on, "left_semi").drop("_strand", "_base")


def shared_contigs(a: DataFrame, b: DataFrame, missing: str = "quiet") -> DataFrame:
    """(chrom) of both tables.  ``missing``: ``quiet`` leaves others out, ``fail`` raises."""
    left, right = a.select("chrom").where("chrom is not null").distinct(), b.select("chrom").where("chrom is not null").distinct()
    if missing == "fail":
        only = left.unionAll(right).groupBy("chrom").count().where("count = 1").limit(5).collect()
        if only:
            raise ValueError(f"contigs of one table only: {', '.join(sorted(r['chrom'] for r in only))}")
    elif missing != "quiet":
        raise ValueError("missing is quiet or fail")
    return left.join(right, "chrom")


def assign_codes(options: list[str]) -> dict[str, str]:
    """``x:C`` gives a code of one's own to a base; the known codes stay."""
    out = dict(BASE_OF_CODE)
    for o in options:
        code, _, base = o.partition(":")
        if not code or base not in COMPLEMENT:
            raise ValueError(f"not code:base: {o}")
        out[code] = base
    return out
