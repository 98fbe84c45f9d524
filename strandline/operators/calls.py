"""Read-level calls: from rows per (position, code) to one row per position, and back to tables.

``positions`` makes, from a table of one row per read position and code, one row per
read position with the map of its code probabilities.  Defined results: rows without
read id, base or code, and codes that do not belong to the base, are left out; a null,
NaN or out-of-range probability makes the position a ``nocall`` unless another code of it
has one; deliveries of the same row again, exact or later, count once; probabilities that
add up to more than 1 contradict each other and the position is left out.  Rows of one
position that differ in strand or k-mers are different positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import probs as P
from strandline.schema import BASE_OF_CODE, base_of_code
from strandline.session import usable

KEY = ("read_id", "sample_id", "flag", "chrom", "ref_pos", "fwd_pos", "mod_strand", "strand", "base")
TEXT = ("ref_strand", "ref_kmer", "query_kmer")
CARRIED = ("ref_strand", "read_len", "clip_start", "clip_end", "base_qual", "ref_kmer", "query_kmer", "inferred")


def is_primary(flag: Column) -> Column:
    """Neither secondary, supplementary nor duplicate."""
    return F.coalesce(flag.bitwiseAND(0xD00) == 0, F.lit(False))


def is_mapped(flag: Column, chrom: Column, ref_pos: Column) -> Column:
    return F.coalesce((flag.bitwiseAND(4) == 0) & chrom.isNotNull() & (ref_pos >= 0), F.lit(False))


def positions(read_mods: DataFrame, code: str = "mod_code", prob: str = "mod_qual") -> DataFrame:
    rows = read_mods.select(
        "read_id",
        "sample_id",
        "flag",
        "chrom",
        F.col("ref_position").alias("ref_pos"),
        F.col("forward_read_position").alias("fwd_pos"),
        "mod_strand",
        F.col("ref_mod_strand").alias("strand"),
        F.col("canonical_base").alias("base"),
        "ref_strand",
        F.col("read_length").alias("read_len"),
        F.col("fw_soft_clipped_start").alias("clip_start"),
        F.col("fw_soft_clipped_end").alias("clip_end"),
        "base_qual",
        "ref_kmer",
        "query_kmer",
        "inferred",
        F.col(code).alias("code"),
        F.when(usable(F.col(prob), 0, 1), F.round(F.col(prob).cast("double"), 9)).alias("p"),
    ).where(base_of_code(F.col("code")) == F.col("base"))
    rows = rows.where("read_id is not null and fwd_pos is not null")
    # One shuffle, by read, which also serves later groupings by read.  Codes are aggregated
    # in a slot each: only numbers are in the buffer, so the aggregation is hashed.
    rows = rows.repartition("read_id")
    codes = sorted(BASE_OF_CODE)
    # as SQL text: an expression of this size is put together faster that way
    slots = [F.expr(f"max(case when code = '{c}' then coalesce(p, -1.0D) end) as p{i}") for i, c in enumerate(codes)]
    wide = rows.groupBy(*KEY, *TEXT).agg(*slots, *[F.max(c).alias(c) for c in CARRIED if c not in TEXT])
    entries = ", ".join(f"named_struct('code', '{c}', 'p', p{i})" for i, c in enumerate(codes))
    out = wide.select(*KEY, *CARRIED, F.expr(f"filter(array({entries}), x -> x.p is not null) as seen"))
    probs = F.map_from_entries(F.filter("seen", lambda x: x["p"] >= 0))
    out = out.select(*KEY, probs.alias("probs"), F.transform("seen", lambda x: x["code"]).alias("codes"), *CARRIED)
    kind = F.when(F.size("probs") == 0, "nocall").otherwise("call")
    return out.withColumn("kind", kind).where(P.total(F.col("probs")) <= P.MOST)


def called(pos: DataFrame, thresholds: P.Thresholds) -> DataFrame:
    """Adds ``call``; positions without probabilities have the kind ``nocall``."""
    none = F.struct(F.lit("nocall").alias("kind"), F.lit(0.0).alias("p"), F.lit(None).cast("string").alias("code"))
    return pos.withColumn("call", F.when(F.col("kind") == "call", P.threshold_call(F.col("probs"), F.col("base"), thresholds)).otherwise(none))


def adjust(pos: DataFrame, ignore: list[str] = (), convert: list[tuple[str, str]] = (), edge: tuple[int, int] | None = None, inverted: bool = False, thresholds: P.Thresholds | None = None) -> DataFrame:
    """Conversions, then codes taken out, then the edge filter, then the threshold filter."""
    probs, codes = F.col("probs"), F.col("codes")
    for source, target in convert:
        probs = P.convert(probs, source, target)
        codes = F.array_distinct(F.transform(codes, _replace(source, target)))
    for code in ignore:
        probs = P.ignore(probs, code)
        codes = F.array_remove(codes, code)
    out = pos.withColumn("probs", probs).withColumn("codes", codes)
    if edge:
        out = out.where(P.within_edges(F.col("fwd_pos"), F.col("read_len"), *edge, inverted))
    if thresholds:
        out = called(out, thresholds).where(F.col("call.kind").isin("canonical", "modified")).drop("call")
    return out


def _replace(source: str, target: str):
    return lambda c: F.when(c == source, target).otherwise(c)


def call_mods(pos: DataFrame, thresholds: P.Thresholds) -> DataFrame:
    """The called class of each position at probability 1; failed calls are left out."""
    c = called(pos.where("kind = 'call'"), thresholds)
    return c.withColumn("probs", P.call_to_probs(F.col("probs"), F.col("call"))).where("probs is not null").drop("call")


def extract_full(pos: DataFrame, mapped_only: bool = False) -> DataFrame:
    """One row per position and code, with the columns of the read-level table."""
    rows = pos.where("kind = 'call'")
    if mapped_only:
        rows = rows.where(is_mapped(F.col("flag"), F.col("chrom"), F.col("ref_pos")))
    return rows.select(*KEY, *CARRIED, F.explode("probs").alias("code", "p"))


def extract_calls(pos: DataFrame, thresholds: P.Thresholds, pass_only: bool = False) -> DataFrame:
    """One row per position: the most probable class is shown, whatever the thresholds;
    ``fail`` says that no class reached its threshold."""
    rows = called(pos.where("kind = 'call'"), thresholds).withColumn("top", P.argmax_call(F.col("probs")))
    within = (F.col("fwd_pos") >= F.col("clip_start")) & (F.col("fwd_pos") < F.col("read_len") - F.col("clip_end"))
    out = rows.select(
        *KEY,
        *CARRIED,
        F.col("top.p").alias("call_prob"),
        F.coalesce("top.code", F.lit("-")).alias("call_code"),
        (F.col("call.kind") == "filtered").alias("fail"),
        (within & is_mapped(F.col("flag"), F.col("chrom"), F.col("ref_pos"))).alias("within_alignment"),
    )
    return out.where("not fail") if pass_only else out


def first_per_read_position(calls: DataFrame) -> DataFrame:
    """Duplicate read names at one position (A35): name, position and how often, where more than once."""
    return calls.groupBy("chrom", "ref_pos", "strand", "read_id").agg(F.count("*").alias("n")).where("n > 1")


def capped_depth(pos: DataFrame, max_depth: int) -> DataFrame:
    """At most ``max_depth`` reads of each position, the first by read id (the cap is the feature)."""
    w = Window.partitionBy("chrom", "ref_pos", "strand").orderBy("read_id", "flag", "fwd_pos", "base")
    return pos.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_depth).drop("_n")


def deletions(reads: DataFrame) -> DataFrame:
    """(read_id, flag, chrom, ref_pos): reference bases that aligned reads have deleted
    (D of their CIGAR), one row each; skipped stretches (N) are no deletions."""
    ops = F.regexp_extract_all("cigar", F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    step = F.struct(F.col("pos").cast("long").alias("at"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("gone"))

    def take(state: Column, op: Column) -> Column:
        kind, n = F.substring(op, -1, 1), F.regexp_extract(op, r"^(\d+)", 1).cast("long")
        at = state["at"] + F.when(kind.isin("M", "=", "X", "D", "N"), n).otherwise(0)
        gone = F.when((kind == "D") & (n > 0), F.array_append(state["gone"], F.struct(state["at"].alias("a"), (at - 1).alias("b")))).otherwise(state["gone"])
        return F.struct(at.alias("at"), gone.alias("gone"))

    rows = reads.where("chrom is not null and pos >= 0 and cigar is not null").where(F.col("flag").bitwiseAND(4) == 0)
    spans = rows.select("read_id", "flag", "chrom", F.inline(F.aggregate(ops, step, take)["gone"]))
    return spans.select("read_id", "flag", "chrom", F.explode(F.sequence("a", "b")).alias("ref_pos"))
