"""Per-position counts of calls.

The tally is one shuffle: every (chrom, position, strand[, partition]) is aggregated once,
with a conditional sum for each code of the vocabulary, combined on the map side; rows
per code are then unfolded from the tally without another shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import probs as P
from strandline.operators.calls import called, capped_depth, is_mapped, is_primary
from strandline.schema import BASE_OF_CODE, CODES_BY_BASE, COLOR

BASES = ("A", "C", "G", "T")
#: Field of each code in a tally; names differ in more than letter case.
SLOT = {code: f"c{i}" for i, code in enumerate(BASE_OF_CODE)}


def partition_key(*tags: Column) -> Column:
    """Tag values joined by ``_``; an absent one is ``missing``; all absent: ``ungrouped``."""
    some = F.coalesce(*tags).isNotNull()
    return F.when(some, F.concat_ws("_", *[F.coalesce(t.cast("string"), F.lit("missing")) for t in tags])).otherwise("ungrouped")


def features(pos: DataFrame, thresholds: P.Thresholds) -> DataFrame:
    """Mapped, primary positions with their call and the codes carried by their read."""
    rows = pos.where(is_primary(F.col("flag")) & is_mapped(F.col("flag"), F.col("chrom"), F.col("ref_pos")) & F.col("strand").isin("+", "-"))
    # positions are laid out by read, so this window sorts but does not shuffle
    of_read = F.array_distinct(F.flatten(F.collect_set("codes").over(Window.partitionBy("read_id"))))
    return called(rows.withColumn("read_codes", of_read), thresholds)


def tally(feat: DataFrame, keys: list[str]) -> DataFrame:
    """One row per ``keys``: counts by state, base and code, and the codes observed."""
    # as SQL text: an expression of this size is put together faster that way
    def counts(kind: str) -> str:
        return ", ".join(f"'{b}', count_if(call.kind = '{kind}' and base = '{b}')" for b in BASES)

    mod = ", ".join(f"'{i}', count_if(call.kind = 'modified' and call.code = '{c}')" for c, i in SLOT.items())
    seen = ", ".join(f"'{i}', max(array_contains(read_codes, '{c}'))" for c, i in SLOT.items())
    return feat.groupBy(*keys).agg(
        F.expr("count_if(call.kind = 'delete') as n_delete"),
        F.expr("count_if(call.kind = 'filtered') as n_fail"),
        F.expr(f"named_struct({counts('nocall')}) as nocall"),
        F.expr(f"named_struct({counts('canonical')}) as can"),
        F.expr(f"named_struct({mod}) as mod"),
        F.expr(f"named_struct({seen}) as seen"),
    )


def rows_of(tallied: DataFrame, keys: list[str], combine_mods: bool = False) -> DataFrame:
    """For each base with a passing call, a row per observed code of the base (or one row
    for the base): n_other counts its other codes, n_diff the calls and missing calls of
    other bases; n_delete and n_fail are those of the whole position."""
    # totals of each base first, so that they are computed once for all codes
    per_base = [f"can.{b} as can_{b}" for b in BASES] + [f"nocall.{b} as nocall_{b}" for b in BASES]
    per_base += [" + ".join(f"mod.{SLOT[c]}" for c in CODES_BY_BASE[b]) + f" as mods_{b}" for b in BASES]
    whole = " + ".join(f"{x}_{b}" for x in ("mods", "can", "nocall") for b in BASES)
    totals = tallied.selectExpr(*[f"`{k}`" for k in keys], "n_delete", "n_fail", "mod", "seen", *per_base).withColumn("whole", F.expr(whole))
    out = []
    for b in BASES:
        for c in [b] if combine_mods else [x for x in CODES_BY_BASE[b] if x != b]:
            n = f"mods_{b}" if combine_mods else f"mod.{SLOT[c]}"
            shown = f"mods_{b} + can_{b} > 0" + ("" if combine_mods else f" and seen.{SLOT[c]}")
            fields = {"base": f"'{b}'", "code": f"'{c}'", "n_mod": n, "n_canonical": f"can_{b}", "n_other": f"mods_{b} - {n}", "n_nocall": f"nocall_{b}", "n_diff": f"whole - mods_{b} - can_{b} - nocall_{b}", "valid_coverage": f"mods_{b} + can_{b}"}
            out.append(f"case when {shown} then named_struct({', '.join(f"'{k}', {v}" for k, v in fields.items())}) end")
    return totals.selectExpr(*[f"`{k}`" for k in keys], "n_delete", "n_fail", f"inline(array({', '.join(out)}))").where("base is not null")


def pileup(pos: DataFrame, thresholds: P.Thresholds, extra_keys: tuple[str, ...] = (), combine_mods: bool = False, combine_strands: dict[str, int] | None = None, max_depth: int | None = None, deletions: DataFrame | None = None) -> DataFrame:
    """Per-position counts: keys, base, code and the eight counts.

    ``max_depth``: so many reads of a position count (``calls.capped_depth``).
    ``deletions``: (read_id, flag, chrom, ref_pos) and the extra keys of bases that reads
    have deleted (``calls.deletions``); they count at both strands of a position.

    ``combine_strands``: partner offset of a palindromic motif (2-base CG: ``{"C": 1}``);
    the − rows of that base are added to the + row that many positions before, with
    strand ``.``."""
    keys = ["chrom", "ref_pos", "strand", *extra_keys]
    feat = features(pos if max_depth is None else capped_depth(pos, max_depth), thresholds)
    if deletions is not None:
        gone = deletions.where(is_primary(F.col("flag")) & is_mapped(F.col("flag"), F.col("chrom"), F.col("ref_pos"))).withColumn("strand", F.explode(F.array(F.lit("+"), F.lit("-"))))
        feat = feat.select(*keys, "base", "call", "read_codes").unionByName(gone.select(*keys, F.lit("").alias("base"), F.struct(F.lit("delete").alias("kind"), F.lit(0.0).alias("p"), F.lit(None).cast("string").alias("code")).alias("call"), F.array().cast("array<string>").alias("read_codes")))
    rows = rows_of(tally(feat, keys), keys, combine_mods)
    if not combine_strands:
        return rows
    shift = F.lit(0)
    for base, offset in combine_strands.items():
        shift = F.when((F.col("base") == base) & (F.col("strand") == "-"), offset).otherwise(shift)
    moved = rows.where(F.col("base").isin(*combine_strands)).withColumn("ref_pos", F.col("ref_pos") - shift).withColumn("strand", F.lit("."))
    counts = ["n_mod", "n_canonical", "n_other", "n_delete", "n_fail", "n_diff", "n_nocall", "valid_coverage"]
    return moved.groupBy(*keys, "base", "code").agg(*[F.sum(c).alias(c) for c in counts])


def to_bedmethyl(rows: DataFrame, extra: tuple[str, ...] = (), name: Column | None = None) -> DataFrame:
    """The 18 columns of a pileup table."""
    valid = F.col("valid_coverage")
    end = F.col("ref_pos") + 1
    return rows.select(
        *extra,
        "chrom",
        F.col("ref_pos").alias("chromStart"),
        end.alias("chromEnd"),
        (name if name is not None else F.col("code")).alias("name"),
        valid.alias("score"),
        "strand",
        F.col("ref_pos").alias("thickStart"),
        end.alias("thickEnd"),
        F.lit(COLOR).alias("color"),
        "valid_coverage",
        F.round(100.0 * F.col("n_mod") / valid, 2).alias("percent_modified"),
        F.col("n_mod").alias("count_modified"),
        F.col("n_canonical").alias("count_canonical"),
        F.col("n_other").alias("count_other_mod"),
        F.col("n_delete").alias("count_delete"),
        F.col("n_fail").alias("count_fail"),
        F.col("n_diff").alias("count_diff"),
        F.col("n_nocall").alias("count_nocall"),
    )


def pileup_hemi(pos: DataFrame, thresholds: P.Thresholds, base: str = "C", offset: int = 1) -> DataFrame:
    """Counts of patterns over both strands: the + call at a position and the − call at
    its partner ``offset`` on, of the same read.

    One row per (chrom, position, pattern): ``first``,``second`` with ``-`` for canonical;
    ``valid`` = pattern counts of the position's base; ``n_fail`` pairs with a filtered
    side, ``n_nocall`` pairs with a missing side (and neither filtered)."""
    feat = called(pos.where(is_primary(F.col("flag")) & is_mapped(F.col("flag"), F.col("chrom"), F.col("ref_pos"))), thresholds)
    side = feat.where(F.col("base") == base).select("read_id", "flag", "chrom", F.when(F.col("strand") == "-", F.col("ref_pos") - offset).otherwise(F.col("ref_pos")).alias("ref_pos"), "strand", F.col("call.kind").alias("kind"), F.coalesce("call.code", F.lit("-")).alias("code"))
    # both sides meet in one group: no self-join
    pick = lambda s: F.max(F.when(F.col("strand") == s, F.struct("kind", "code")))
    pair = side.groupBy("read_id", "flag", "chrom", "ref_pos").agg(pick("+").alias("a"), pick("-").alias("b"))
    kinds = [F.coalesce(F.col(f"{x}.kind"), F.lit("nocall")) for x in ("a", "b")]
    state = F.when((kinds[0] == "filtered") | (kinds[1] == "filtered"), "fail").when((kinds[0] == "nocall") | (kinds[1] == "nocall"), "nocall").otherwise("pattern")
    labelled = pair.withColumn("state", state).withColumn("pattern", F.when(F.col("state") == "pattern", F.concat_ws(",", F.col("a.code"), F.col("b.code"), F.lit(base))))
    by = labelled.groupBy("chrom", "ref_pos", "pattern").agg(F.sum((F.col("state") == "fail").cast("long")).alias("fail"), F.sum((F.col("state") == "nocall").cast("long")).alias("nocall"), F.sum((F.col("state") == "pattern").cast("long")).alias("n"))
    site = by.groupBy("chrom", "ref_pos").agg(
        F.sum("fail").alias("n_fail"), F.sum("nocall").alias("n_nocall"), F.sum("n").alias("valid"),
        F.collect_list(F.when(F.col("pattern").isNotNull(), F.struct("pattern", "n"))).alias("patterns"),
    )
    rows = site.select("chrom", "ref_pos", "n_fail", "n_nocall", "valid", F.inline("patterns"))
    canonical = F.col("pattern") == f"-,-,{base}"
    can = F.sum(F.when(canonical, F.col("n")).otherwise(0)).over(Window.partitionBy("chrom", "ref_pos"))
    return rows.select("chrom", "ref_pos", F.lit(".").alias("strand"), "pattern", "n", can.cast("long").alias("n_canonical"), (F.col("valid") - F.col("n") - F.when(canonical, 0).otherwise(can)).cast("long").alias("n_other"), "n_fail", "n_nocall", F.col("valid").alias("valid_coverage"))
