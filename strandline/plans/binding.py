"""The domain's inputs, taken from the driver's tables by rules that SQL can state too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.probs import Thresholds
from strandline.operators.calls import positions
from strandline.schema import BASE_OF_CODE
from strandline.session import table

THRESHOLDS = Thresholds(0.7, {"A": 0.6}, {"h": 0.8})
REGIONS_PER_CONTIG = 50


def read_positions(spark: SparkSession, d: str) -> DataFrame:
    return positions(table(spark, d, "read_mods"))


def regions(spark: SparkSession, d: str) -> DataFrame:
    """Named regions covering half of every contig; every third is stranded."""
    rows = table(spark, d, "contigs").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(REGIONS_PER_CONTIG - 1).cast("long"))))
    n = REGIONS_PER_CONTIG
    return rows.select(
        "chrom",
        F.expr(f"(i * size) div {n}").alias("start"),
        F.expr(f"(i * size) div {n} + size div {2 * n}").alias("end"),
        F.concat("chrom", F.lit("_"), F.col("i").cast("string")).alias("region_name"),
        F.when(F.col("i") % 3 == 1, "+").when(F.col("i") % 3 == 2, "-").otherwise(".").alias("strand"),
    ).where("end > start")


REGIONS_SQL = f"""regions as (select chrom, (i * size) // {REGIONS_PER_CONTIG} as start, (i * size) // {REGIONS_PER_CONTIG} + size // {2 * REGIONS_PER_CONTIG} as "end",
  chrom || '_' || i as region_name, case i % 3 when 1 then '+' when 2 then '-' else '.' end as strand
  from contigs, (select unnest(range({REGIONS_PER_CONTIG})) as i) where size // {2 * REGIONS_PER_CONTIG} > 0)"""

KEYS = "read_id, sample_id, flag, chrom, ref_pos, fwd_pos, mod_strand, strand, base"
_VOCABULARY = ", ".join(f"('{c}', '{b}')" for c, b in BASE_OF_CODE.items())
#: m: rows per position and code; p is null where it is not usable; s, n: sum and number of the position's probabilities.
MODS_SQL = f"""cb(code, base) as (values {_VOCABULARY}),
m0 as (select r.read_id, r.sample_id, r.flag, r.chrom, r.ref_position as ref_pos, r.forward_read_position as fwd_pos, r.mod_strand, r.ref_mod_strand as strand,
         r.canonical_base as base, r.mod_code as code, max(case when r.mod_qual between 0 and 1 and not isnan(r.mod_qual) then round(r.mod_qual::double, 9) end) as p,
         max(r.read_length) as read_len, max(r.fw_soft_clipped_start) as clip_start, max(r.fw_soft_clipped_end) as clip_end, max(r.base_qual) as base_qual, max(r.ref_kmer) as ref_kmer,
         max(r.query_kmer) as query_kmer, bool_or(r.inferred) as inferred
       from read_mods r join cb on cb.code = r.mod_code and cb.base = r.canonical_base where r.read_id is not null and r.forward_read_position is not null group by all),
m as (select * from (select *, sum(p) over w as s, count(p) over w as n from m0 window w as (partition by {KEYS})) where coalesce(s, 0) <= 1.000001),
cls as (select {KEYS}, code, p, case when regexp_full_match(code, '[0-9]+') then 1000000000 - try_cast(code as int) else -ascii(code) end as pref from m where p is not null
        union all select distinct {KEYS}, '-', 1 - s, 2000000000 from m where n > 0)"""


def threshold_sql(t: Thresholds = THRESHOLDS) -> str:
    base = "case base " + " ".join(f"when '{b}' then {v}" for b, v in t.per_base.items()) + f" else {t.default} end" if t.per_base else str(t.default)
    mods = " ".join(f"when code = '{c}' then {v}" for c, v in t.per_mod.items())
    return f"case when code = '-' then {base} {mods} else {base} end"


#: c: one row per position: top class, best passing class, kind.
CALLS_SQL = (
    MODS_SQL
    + f""",
c0 as (select {KEYS}, max(struct_pack(p := p, pref := pref, code := code)) as top, max(struct_pack(p := p, pref := pref, code := code)) filter (where p >= {threshold_sql()}) as best from cls group by all),
c as (select {KEYS}, top.p as top_p, top.code as top_code, best.p as call_p, best.code as call_code,
             case when best is null then 'filtered' when best.code = '-' then 'canonical' else 'modified' end as kind from c0
      union all select distinct {KEYS}, null::double, null, null::double, null, 'nocall' from m where n = 0)"""
)
