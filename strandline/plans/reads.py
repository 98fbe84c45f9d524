"""Queries on read-level tables and pileups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import probs as P
from strandline.functions.seq import Motif
from strandline.operators import calls, pileup, reference, thresholds
from strandline.operators.intervals import points_in
from strandline.plans.binding import CALLS_SQL, KEYS, MODS_SQL, REGIONS_SQL, THRESHOLDS, read_positions, regions
from strandline.session import shared_folder, table
from strandline.sources import layout, writers

QS = (0.1, 0.5, 0.9)
CG = {"C": 1}
FETCH_BIN = 1 << 26  # few rows a folder here


def _cg(pos: DataFrame) -> DataFrame:
    """Positions of C in the motif CG, by the reference k-mer around them."""
    return pos.where((F.col("base") == "C") & (F.substring("ref_kmer", 3, 2) == "CG"))


def c1_pileup(spark: SparkSession, d: str) -> DataFrame:
    return pileup.to_bedmethyl(pileup.pileup(read_positions(spark, d), THRESHOLDS))


def c1_pileup_combined_mods(spark: SparkSession, d: str) -> DataFrame:
    return pileup.to_bedmethyl(pileup.pileup(read_positions(spark, d), THRESHOLDS, combine_mods=True))


def c1_pileup_by_sample(spark: SparkSession, d: str) -> DataFrame:
    pos = read_positions(spark, d).withColumn("partition_key", pileup.partition_key(F.col("sample_id")))
    return pileup.to_bedmethyl(pileup.pileup(pos, THRESHOLDS, ("partition_key",)), ("partition_key",))


def c1_pileup_cg_combined_strands(spark: SparkSession, d: str) -> DataFrame:
    """The preset: motif CG only, h ignored, strands combined."""
    pos = calls.adjust(_cg(read_positions(spark, d)), ignore=["h"])
    return pileup.to_bedmethyl(pileup.pileup(pos, THRESHOLDS, combine_strands=CG))


def c1_pileup_edge_filter(spark: SparkSession, d: str) -> DataFrame:
    return pileup.to_bedmethyl(pileup.pileup(calls.adjust(read_positions(spark, d), edge=(20, 30)), THRESHOLDS))


def c2_pileup_hemi(spark: SparkSession, d: str) -> DataFrame:
    return pileup.pileup_hemi(_duplex(read_positions(spark, d)), THRESHOLDS)


def c2_hemi_bedmethyl(spark: SparkSession, d: str) -> DataFrame:
    """The same in the 18 columns of a pileup table."""
    return writers.hemi_bedmethyl(c2_pileup_hemi(spark, d))


def _duplex(pos: DataFrame) -> DataFrame:
    """Calls of C on + with a partner on −: like it, or canonical, or (every third position
    of the read) without one."""
    plus = pos.where("base = 'C' and strand = '+'")
    canonical = F.transform_values("probs", lambda _, p: p * 0)
    probs = F.when(F.col("fwd_pos") % 3 == 1, canonical).otherwise(F.col("probs"))
    minus = plus.where("fwd_pos % 3 <> 2").withColumns({"strand": F.lit("-"), "ref_pos": F.col("ref_pos") + 1, "probs": probs})
    return plus.unionByName(minus)


def _flat(df: DataFrame) -> DataFrame:
    return df.select(*KEYS.split(", "), F.explode("probs").alias("code", "p")).withColumn("p", F.round("p", 6))


def c3_ignore(spark: SparkSession, d: str) -> DataFrame:
    """h is taken out and shared by the other classes."""
    return _flat(calls.adjust(read_positions(spark, d).where("kind = 'call'"), ignore=["h"]))


def c3_convert(spark: SparkSession, d: str) -> DataFrame:
    return _flat(calls.adjust(read_positions(spark, d).where("kind = 'call'"), convert=[("h", "m"), ("17596", "a")]))


def c3_filter(spark: SparkSession, d: str) -> DataFrame:
    return _flat(calls.adjust(read_positions(spark, d).where("kind = 'call'"), edge=(10, 10), thresholds=THRESHOLDS))


def c5_call_mods(spark: SparkSession, d: str) -> DataFrame:
    return _flat(calls.call_mods(read_positions(spark, d), THRESHOLDS))


def c6_sample_probs(spark: SparkSession, d: str) -> DataFrame:
    return thresholds.base_percentiles(read_positions(spark, d), list(QS)).withColumn("value", F.round("value", 6))


def c6_histogram(spark: SparkSession, d: str) -> DataFrame:
    return thresholds.histogram(read_positions(spark, d)).withColumn("frac", F.round("frac", 9)).withColumn("percentile", F.round("percentile", 9))


def c7_summary(spark: SparkSession, d: str) -> DataFrame:
    return thresholds.summary(read_positions(spark, d), THRESHOLDS).withColumn("pass_frac", F.round("pass_frac", 9)).withColumn("all_frac", F.round("all_frac", 9))


def c8_extract_full(spark: SparkSession, d: str) -> DataFrame:
    return calls.extract_full(read_positions(spark, d))


def c9_extract_calls(spark: SparkSession, d: str) -> DataFrame:
    return calls.extract_calls(read_positions(spark, d), THRESHOLDS).withColumn("call_prob", F.round("call_prob", 6))


def f20_include_exclude(spark: SparkSession, d: str) -> DataFrame:
    """Mapped positions inside a region of their strand and outside every third region of any strand."""
    pos = calls.extract_full(read_positions(spark, d), mapped_only=True).select(*KEYS.split(", "), "code", "p")
    r = regions(spark, d)
    inside = points_in(pos, r.select("chrom", "start", "end", "strand"), "ref_pos", "semi", "strand")
    holes = r.where(F.col("region_name").rlike("[05]$")).select("chrom", "start", "end", "strand")
    return points_in(inside, holes, "ref_pos", "anti")


def l2_contig_quotas(spark: SparkSession, d: str) -> DataFrame:
    return thresholds.contig_quotas(_reads(spark, d), 1000)


def l3_sample_even(spark: SparkSession, d: str) -> DataFrame:
    return thresholds.sample_even(_reads(spark, d), 1000)


def _reads(spark: SparkSession, d: str) -> DataFrame:
    pos = read_positions(spark, d).where(calls.is_primary(F.col("flag")) & calls.is_mapped(F.col("flag"), F.col("chrom"), F.col("ref_pos")))
    return pos.groupBy("read_id", "flag", "chrom").agg(F.min("ref_pos").alias("ref_start"), (F.max("ref_pos") + 1).alias("ref_end"))


def _focus_hits(spark: SparkSession, d: str) -> DataFrame:
    """Two motifs, as the reference k-mers of the reads show them."""
    k = table(spark, d, "read_mods").where("chrom is not null and ref_position >= 0 and ref_mod_strand in ('+', '-')").select("chrom", F.col("ref_position").alias("pos"), F.col("ref_mod_strand").alias("strand"), F.col("ref_kmer").alias("k")).distinct()
    hit = lambda m, o, p: k.where(F.col("k").rlike(p)).select("chrom", F.lit(m).alias("motif"), F.lit(o).alias("offset"), "pos", "strand")
    return hit("CG", 0, "^..CG.$").unionByName(hit("CGA", 0, "^..CGA$"))


def f18_motif_focus(spark: SparkSession, d: str) -> DataFrame:
    """Counts at the positions of several motifs: a row for each motif of a position."""
    pos = reference.focus(read_positions(spark, d), _focus_hits(spark, d))
    bed = pileup.pileup(pos, THRESHOLDS, ("motif_label",))
    return pileup.to_bedmethyl(bed, name=F.concat_ws(",", "code", "motif_label"))


def f31_read_motif(spark: SparkSession, d: str) -> DataFrame:
    """Probabilities at CG of the read itself, and how many are elsewhere."""
    pos = read_positions(spark, d).where("kind = 'call' and base = 'C'")
    kept, rest = reference.read_motif(pos, Motif("CG", 0)), reference.read_motif(pos, Motif("CG", 0), keep=False)
    return kept.withColumn("at_motif", F.lit(True)).unionByName(rest.withColumn("at_motif", F.lit(False))).groupBy("at_motif", "strand").agg(F.count("*").alias("n"))


def a35_duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    """Positions that a read name covers more than once; every fifth position of a read is
    there twice for that."""
    pos = read_positions(spark, d).where(calls.is_mapped(F.col("flag"), F.col("chrom"), F.col("ref_pos")))
    twice = F.when(F.col("fwd_pos") % 5 == 0, 2).otherwise(1)
    return calls.first_per_read_position(pos.withColumn("_copy", F.explode(F.sequence(F.lit(1), twice))))


def l2_pruned_quotas(spark: SparkSession, d: str) -> DataFrame:
    """So few reads wanted that small contigs are left out."""
    return thresholds.contig_quotas(_reads(spark, d), 20)


def f38_region_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Pileup rows of two regions, fetched from a table laid out by (chrom, bin)."""
    at = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    layout.write(table(spark, d, "bedmethyl"), at, "chromstart", "chromend", FETCH_BIN)
    sizes = {r["chrom"]: r["size"] for r in table(spark, d, "contigs").where("chrom = 'chr2'").collect()}
    return layout.fetch(spark, at, [layout.parse_region(r, sizes) for r in ("chr2", "chr7:1,000,000-90,000,000")], "chromstart", "chromend", FETCH_BIN).select("sample_id", "chrom", "chromstart", "strand", "name", "valid_coverage", "count_modified")


QUERIES = {
    f.__name__: f
    for f in (
        c1_pileup, c1_pileup_combined_mods, c1_pileup_by_sample, c1_pileup_cg_combined_strands, c1_pileup_edge_filter, c2_pileup_hemi,
        c3_ignore, c3_convert, c3_filter, c5_call_mods, c6_sample_probs, c6_histogram, c7_summary, c8_extract_full, c9_extract_calls,
        f20_include_exclude, f18_motif_focus, f31_read_motif, l2_contig_quotas, l2_pruned_quotas, l3_sample_even, a35_duplicate_names, c2_hemi_bedmethyl, f38_region_fetch,
    )
}

# ---------------------------------------------------------------- SQL

_MAPPED = "(flag & 4) = 0 and chrom is not null and ref_pos >= 0"
_PRIMARY = "(flag & 3328) = 0"


def _bed_sql(ctes: str, keys: str, combine_mods: bool = False, strands: bool = False, show: str = "", where: str = "true") -> str:
    shift = "ref_pos - case when strand = '-' then 1 else 0 end" if strands else "ref_pos"
    obs = "" if combine_mods else ", obs as (select distinct " + keys + ", rc.base, rc.code from feat join rc using (read_id))"
    code = "base" if combine_mods else "code"
    n = "s_mods" if combine_mods else "coalesce(k.n, 0)"
    source = "from b" if combine_mods else f"from b join obs using ({keys}, base) left join k using ({keys}, base, code)"
    group = "chrom, pos, '.' as strand, " + code + " as name" if strands else "chrom, ref_pos as pos, strand, " + code + " as name"
    sums = "n_mod n_can n_other n_delete n_fail n_diff n_nocall valid".split()
    inner = f"""
select {keys.replace("ref_pos", "ref_pos")}, {shift} as pos, base, {code if not combine_mods else "base as code"}, {n} as n_mod, n_can, s_mods - {n} as n_other, 0 as n_delete, n_fail, s_all - s_mods - n_can - n_nocall as n_diff, n_nocall, s_mods + n_can as valid
{source} where s_mods + n_can > 0 and {where}"""
    outer = f"select {group}, " + ", ".join(f"sum({s})::bigint as {s}" for s in sums) + f" from x group by chrom, pos, {code if not combine_mods else 'base'}" if strands else f"select {show} {group}, " + ", ".join(sums) + " from x"
    return f"""with {ctes},
feat as (select * from c where {_PRIMARY} and {_MAPPED} and strand in ('+', '-')),
rc as (select distinct m.read_id, m.base, m.code from m where {_PRIMARY} and {_MAPPED} and m.strand in ('+', '-')){obs},
k as (select {keys}, base, call_code as code, count(*) as n from feat where kind = 'modified' group by all),
st as (select {keys}, count(*) filter (kind = 'filtered') as n_fail, count(*) filter (kind in ('nocall', 'canonical', 'modified')) as s_all from feat group by all),
b as (select {keys}, base, count(*) filter (kind = 'canonical') as n_can, count(*) filter (kind = 'modified') as s_mods, count(*) filter (kind = 'nocall') as n_nocall, any_value(n_fail) as n_fail, any_value(s_all) as s_all
      from feat join st using ({keys}) group by {keys}, base),
x as ({inner}), y as ({outer})
select {show} chrom, pos as "chromStart", pos + 1 as "chromEnd", name, valid as score, strand, pos as "thickStart", pos + 1 as "thickEnd", '255,0,0' as color, valid as valid_coverage,
 round(100.0::double * n_mod / valid, 2) as percent_modified, n_mod as count_modified, n_can as count_canonical, n_other as count_other_mod, n_delete::bigint as count_delete, n_fail as count_fail, n_diff as count_diff, n_nocall as count_nocall from y"""


_K = "chrom, ref_pos, strand"
_EDGE = "fwd_pos >= {0} and fwd_pos < read_len - {1} and read_len > {0} and read_len > {1}"
_EDGED = CALLS_SQL.replace("where coalesce(s, 0) <= 1.000001)", "where coalesce(s, 0) <= 1.000001 and " + _EDGE.format(20, 30) + ")")
# h taken out of CG sites: p and s are replaced before classes are made
_CG_M = MODS_SQL.replace("\nm as (", "\nm9 as (").replace(
    "cls as (",
    f"""m as (select * replace (p + coalesce(h / n, 0) as p, s - coalesce(h / n, 0) as s) from
   (select *, max(case when code = 'h' then p end) over (partition by {KEYS}) as h from m9 where base = 'C' and substring(ref_kmer, 3, 2) = 'CG')),
cls as (""",
).replace("from m where p is not null", "from m where p is not null and code <> 'h'")
_QV = ", ".join(f"({q}::double)" for q in QS)
_CG_SQL = CALLS_SQL.replace(MODS_SQL, _CG_M)

# calls of C on + and, for two in three, a partner on −
_DUPLEX = CALLS_SQL.replace(MODS_SQL, MODS_SQL.replace("\nm as (", "\nm9 as (").replace(
    "cls as (",
    """m as (select * from m9 where base = 'C' and strand = '+' union all
   select * replace ('-' as strand, ref_pos + 1 as ref_pos, case when fwd_pos % 3 = 1 then p * 0 else p end as p, case when fwd_pos % 3 = 1 then s * 0 else s end as s) from m9 where base = 'C' and strand = '+' and fwd_pos % 3 <> 2),
cls as (""", 1))
_HEMI = f"""with {_DUPLEX},
side as (select read_id, flag, chrom, case when strand = '-' then ref_pos - 1 else ref_pos end as ref_pos, strand, kind, coalesce(call_code, '-') as code from c where {_PRIMARY} and {_MAPPED} and base = 'C'),
pr as (select read_id, flag, chrom, ref_pos, max(struct_pack(kind := kind, code := code)) filter (strand = '+') as a, max(struct_pack(kind := kind, code := code)) filter (strand = '-') as b from side group by all),
l as (select chrom, ref_pos, case when coalesce(a.kind, '') = 'filtered' or coalesce(b.kind, '') = 'filtered' then 'fail' when coalesce(a.kind, 'nocall') = 'nocall' or coalesce(b.kind, 'nocall') = 'nocall' then 'nocall' else a.code || ',' || b.code || ',C' end as pat from pr),
g as (select chrom, ref_pos, pat, count(*) as n from l group by all),
s as (select chrom, ref_pos, coalesce(sum(n) filter (pat = 'fail'), 0)::bigint as n_fail, coalesce(sum(n) filter (pat = 'nocall'), 0)::bigint as n_nocall, sum(n) filter (pat like '%,C') as valid, coalesce(sum(n) filter (pat = '-,-,C'), 0) as can from g group by all)
select chrom, ref_pos, '.' as strand, pat as pattern, n, can::bigint as n_canonical, (valid - n - case when pat = '-,-,C' then 0 else can end)::bigint as n_other, n_fail, n_nocall, valid::bigint as valid_coverage from g join s using (chrom, ref_pos) where pat like '%,C'"""

ORACLES = {
    "c1_pileup": _bed_sql(CALLS_SQL, _K),
    "c1_pileup_combined_mods": _bed_sql(CALLS_SQL, _K, combine_mods=True),
    "c1_pileup_by_sample": _bed_sql(CALLS_SQL.replace("m0 as (select r.read_id", "m0 as (select coalesce(r.sample_id, 'ungrouped') as partition_key, r.read_id").replace(KEYS, "partition_key, " + KEYS), "partition_key, " + _K, show="partition_key,"),
    "c1_pileup_edge_filter": _bed_sql(_EDGED, _K),
    "c1_pileup_cg_combined_strands": _bed_sql(_CG_SQL, _K, strands=True).replace("m.code from m where", "m.code from m where m.code <> 'h' and"),
    "c2_pileup_hemi": _HEMI,
    "c2_hemi_bedmethyl": f"""select chrom, ref_pos as "chromStart", ref_pos + 1 as "chromEnd", pattern as name, valid_coverage as score, strand, ref_pos as "thickStart", ref_pos + 1 as "thickEnd", '255,0,0' as color, valid_coverage,
 round(100.0::double * n / valid_coverage, 2) as percent_modified, n as count_modified, n_canonical as count_canonical, n_other as count_other_mod, 0::bigint as count_delete, n_fail as count_fail, 0::bigint as count_diff, n_nocall as count_nocall from ({_HEMI})""",
    "l2_pruned_quotas": f"with {MODS_SQL}, r as (select distinct read_id, flag, chrom from m where {_PRIMARY} and {_MAPPED}), g as (select chrom, count(*) as n from r group by chrom), "
    "q as (select *, least(n, ceil(n * (20.0::double / sum(n) over ()) - 1e-9))::bigint as quota from g), w as (select *, sum(quota) over () as total, coalesce(sum(quota) over (order by quota, chrom rows between unbounded preceding and 1 preceding), 0) as upto, "
    "coalesce(sum(quota) over (order by quota range between unbounded preceding and 1 preceding), 0) as lower from q) select chrom, n, case when total > 30 and total - upto > 20 and total - lower > 30 then 0 else quota end as quota from w",
    "f38_region_fetch": "select sample_id, chrom, chromstart, strand, name, valid_coverage, count_modified from bedmethyl where chromstart is not null and (chrom = 'chr2' or chrom = 'chr7' and chromstart < 90000000 and chromend > 1000000)",
    "c3_ignore": f"with {MODS_SQL}, h as (select *, max(case when code = 'h' then p end) over (partition by {KEYS}) as h from m where p is not null) select {KEYS}, code, round(p + coalesce(h / n, 0), 6) as p from h where code <> 'h'",
    "c3_convert": f"with {MODS_SQL} select {KEYS}, case code when 'h' then 'm' when '17596' then 'a' else code end as code, round(sum(p), 6) as p from m where p is not null group by {KEYS}, case code when 'h' then 'm' when '17596' then 'a' else code end",
    "c3_filter": f"with {CALLS_SQL} select m.* exclude (read_len) from (select {KEYS}, code, round(p, 6) as p, read_len from m where p is not null) m semi join (select * from c where kind in ('canonical', 'modified')) c on "
    + " and ".join(f"m.{k} is not distinct from c.{k}" for k in KEYS.split(", ")) + " where " + _EDGE.format(10, 10),
    "c5_call_mods": f"with {CALLS_SQL} select {', '.join('m.' + k for k in KEYS.split(', '))}, m.code, case when m.code = c.call_code then 1.0::double else 0.0 end as p from m join c on "
    + " and ".join(f"m.{k} is not distinct from c.{k}" for k in KEYS.split(", ")) + " where m.p is not null and c.kind in ('canonical', 'modified')",
    "c6_sample_probs": f"with {CALLS_SQL}, r as (select base, top_p, row_number() over (partition by base order by top_p) - 1 as i, count(*) over (partition by base) as n from c where kind <> 'nocall'), "
    f"t as (select distinct base, n, q, (n - 1) * q as spot from r, (values {_QV}) x(q) where n >= 2) "
    "select t.base, t.n, t.q, round(max(case when r.i = floor(spot) then top_p end) * (1 - (spot - floor(spot))) + max(case when r.i = ceil(spot) then top_p end) * (spot - floor(spot)), 6) as value from t join r on r.base = t.base and r.i in (floor(spot), ceil(spot)) group by t.base, t.n, t.q, spot",
    "c6_histogram": f"with {MODS_SQL}, b as (select base, code, (case when p = 1 then 255 else floor(p * 256) end)::int as qual, count(*) as n from m where p is not null group by all) "
    "select base, code, qual, n, round(n / sum(n) over (partition by base, code), 9) as frac, round((sum(n) over (partition by base, code order by qual) - n / 2.0::double) / sum(n) over (partition by base, code), 9) as percentile from b",
    "c7_summary": f"with {CALLS_SQL}, k as (select *, case when kind = 'filtered' then top_code else call_code end as code from c where kind <> 'nocall'), "
    "g as (select base, code, count(*) filter (kind <> 'filtered') as pass_count, count(*) filter (kind = 'filtered') as fail_count, count(*) as all_count from k group by all), rd as (select base, count(distinct read_id) as reads from k group by base) "
    "select g.*, coalesce(round(pass_count / nullif(sum(pass_count) over (partition by base), 0), 9), 0) as pass_frac, round(all_count / sum(all_count) over (partition by base), 9) as all_frac, reads from g join rd using (base)",
    "c8_extract_full": f"with {MODS_SQL}, a as (select {KEYS}, max(ref_kmer) as ref_kmer, max(query_kmer) as query_kmer, max(read_len) as read_len, max(clip_start) as clip_start, max(clip_end) as clip_end, max(base_qual) as base_qual, bool_or(inferred) as inferred, list(struct_pack(code := code, p := p)) filter (p is not null) as l from m group by {KEYS}) "
    f"select {KEYS}, u.code as code, u.p as p, ref_kmer, query_kmer, read_len, clip_start, clip_end, base_qual, inferred, case when strand = '.' then '.' else case when strand = mod_strand then '+' else '-' end end as ref_strand from (select *, unnest(l) as u from a)",
    "f20_include_exclude": f"with {MODS_SQL}, {REGIONS_SQL} select {KEYS}, code, p from m where p is not null and {_MAPPED} "
    "and exists (select 1 from regions r where r.chrom = m.chrom and m.ref_pos >= r.start and m.ref_pos < r.\"end\" and (r.strand = '.' or m.strand = '.' or r.strand = m.strand)) "
    "and not exists (select 1 from regions r where r.chrom = m.chrom and m.ref_pos >= r.start and m.ref_pos < r.\"end\" and regexp_matches(r.region_name, '[05]$'))",
    "f18_motif_focus": _bed_sql(
        CALLS_SQL.replace("m0 as (select r.read_id", "m0 as (select hm.motif_label, r.read_id").replace(
            " where r.read_id is not null",
            " join hm on hm.chrom = r.chrom and hm.pos = r.ref_position and hm.strand = r.ref_mod_strand where r.read_id is not null",
        ).replace(KEYS, "motif_label, " + KEYS).replace(
            "m0 as (",
            "hk as (select distinct chrom, ref_position as pos, ref_mod_strand as strand, ref_kmer as k from read_mods where chrom is not null and ref_position >= 0 and ref_mod_strand in ('+', '-')), "
            "hm as (select distinct chrom, pos, strand, 'CG,0' as motif_label from hk where regexp_full_match(k, '..CG.') union all select distinct chrom, pos, strand, 'CGA,0' from hk where regexp_full_match(k, '..CGA')),\nm0 as (", 1),
        "motif_label, " + _K, show="motif_label,",
    ).replace("select motif_label, chrom, pos as", "select chrom, pos as").replace("pos + 1 as \"chromEnd\", name,", "pos + 1 as \"chromEnd\", name || ',' || motif_label as name,"),
    "f31_read_motif": f"with {MODS_SQL}, a as (select {KEYS}, max(query_kmer) as qk from m where n > 0 and base = 'C' group by {KEYS}) select coalesce(regexp_full_match(qk, '..CG.'), false) as at_motif, strand, count(*) as n from a group by 1, 2",
    "l2_contig_quotas": f"with {MODS_SQL}, r as (select distinct read_id, flag, chrom from m where {_PRIMARY} and {_MAPPED}), g as (select chrom, count(*) as n from r group by chrom) "
    "select chrom, n, least(n, ceil(n * (1000.0::double / sum(n) over ()) - 1e-9))::bigint as quota from g",
    "l3_sample_even": f"with {MODS_SQL}, r as (select read_id, flag, chrom, min(ref_pos) as ref_start from m where {_PRIMARY} and {_MAPPED} group by all), "
    "g as (select chrom, count(*) as n, min(ref_start) as lo, max(ref_start) as hi from r group by chrom), q as (select *, least(n, ceil(n * (1000.0::double / sum(n) over ()) - 1e-9)) as quota from g), "
    "b as (select r.*, quota, floor((ref_start - lo) / greatest(1.0::double, (hi - lo + 1) / 64.0::double))::int as bin from r join q using (chrom)) "
    "select read_id, flag, chrom, ref_start, bin from b qualify row_number() over (partition by chrom, bin order by md5(read_id), read_id, flag) <= ceil(quota / 64.0::double - 1e-9)",
    "a35_duplicate_names": f"with {CALLS_SQL} select chrom, ref_pos, strand, read_id, count(*) as n from (select * from c union all select * from c where fwd_pos % 5 = 0) where {_MAPPED} group by all having count(*) > 1",
    "c9_extract_calls": f"with {CALLS_SQL}, a as (select {KEYS}, max(ref_kmer) as ref_kmer, max(query_kmer) as query_kmer, max(read_len) as read_len, max(clip_start) as clip_start, max(clip_end) as clip_end, max(base_qual) as base_qual, bool_or(inferred) as inferred from m group by {KEYS}) "
    f"select {', '.join('c.' + k for k in KEYS.split(', '))}, round(c.top_p, 6) as call_prob, c.top_code as call_code, c.kind = 'filtered' as fail, c.fwd_pos >= clip_start and c.fwd_pos < read_len - clip_end and coalesce((c.flag & 4) = 0 and c.chrom is not null and c.ref_pos >= 0, false) as within_alignment, "
    "ref_kmer, query_kmer, read_len, clip_start, clip_end, base_qual, inferred, case when c.strand = '.' then '.' when c.strand = c.mod_strand then '+' else '-' end as ref_strand from c join a on "
    + " and ".join(f"c.{k} is not distinct from a.{k}" for k in KEYS.split(", ")) + " where kind <> 'nocall'",
}
