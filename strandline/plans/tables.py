"""Queries on pileup tables: merging, regions, profiles, tracks, differences, entropy, truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import stats
from strandline.operators import calls, dmr, entropy, intervals, tables, validate
from strandline.operators.thresholds import estimate_thresholds, summary
from strandline.plans.binding import CALLS_SQL, KEYS, MODS_SQL, REGIONS_SQL, THRESHOLDS, read_positions, regions, threshold_sql
from strandline.schema import BASE_OF_CODE, COUNT_COLUMNS
from strandline.session import materialize, table

STAT_CODES = ["m", "h", "a"]
LOCAL_WINDOW = 50_000
A, B = "smp_0001", "smp_0002"
SPAN, WINDOW_N = 20_000, 2


def c20_localize(spark: SparkSession, d: str) -> DataFrame:
    return tables.localize(table(spark, d, "bedmethyl"), regions(spark, d), table(spark, d, "contigs"), LOCAL_WINDOW)


def c21_stats(spark: SparkSession, d: str) -> DataFrame:
    return tables.region_stats(table(spark, d, "bedmethyl"), regions(spark, d), STAT_CODES)


def c22_merge(spark: SparkSession, d: str) -> DataFrame:
    return tables.merge(table(spark, d, "bedmethyl"))


def c23_track(spark: SparkSession, d: str) -> DataFrame:
    return tables.track(table(spark, d, "bedmethyl"), ["m", "h"])


def j11_containing(spark: SparkSession, d: str) -> DataFrame:
    """Reads with the regions of 5 bases that they cover: one every 25 bases of their contig."""
    pos = read_positions(spark, d).where(calls.is_primary(F.col("flag")) & calls.is_mapped(F.col("flag"), F.col("chrom"), F.col("ref_pos")))
    reads = pos.groupBy("read_id", "flag", "chrom").agg(F.min("ref_pos").alias("ref_start"), (F.max("ref_pos") + 1).alias("ref_end"))
    wins = reads.select("chrom", F.expr("(ref_start div 25 + 1) * 25").alias("start")).distinct().withColumn("end", F.col("start") + 5)
    return intervals.containing(reads, wins).select("read_id", "flag", "chrom", "start", "end")


def u4_interval_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "bedmethyl").where("chromstart is not null").select("chrom", F.greatest(F.lit(0), F.col("chromstart") - 500).alias("start"), (F.col("chromstart") + 500).alias("end"))
    return intervals.merge(rows)


def _counts(spark: SparkSession, d: str, samples: list[str] | None = None) -> DataFrame:
    rows = table(spark, d, "bedmethyl")
    return dmr.position_counts(dmr.best_rows(rows if samples is None else rows.where(F.col("sample_id").isin(samples))))


def a17_contradictions(spark: SparkSession, d: str) -> DataFrame:
    return dmr.contradictions(dmr.best_rows(table(spark, d, "bedmethyl")))


def c11_region_pair(spark: SparkSession, d: str) -> DataFrame:
    by = dmr.region_counts(_counts(spark, d, [A, B]), regions(spark, d))
    return _rounded(dmr.region_pairs(by, [(A, B)]))


def c13_region_multi(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(dmr.region_pairs(dmr.region_counts(_counts(spark, d), regions(spark, d))))


def _rounded(df: DataFrame) -> DataFrame:
    for c in ("score", "a_pct_modified", "b_pct_modified", "effect_size"):
        if c in df.columns:
            df = df.withColumn(c, F.round(c, 5) + 0.0)
    return df


CELL = 10_000
SEGMENT_GAP, SEGMENT_DECAY = 1_000_000, 100_000


def _cells(spark: SparkSession, d: str, by: str, cell: int = CELL) -> DataFrame:
    """Counts of exact positions, added up in cells so that samples meet: re-deliveries are
    picked and contradictions left out position by position, and then every position counts."""
    counts = _counts(spark, d).withColumn("chromstart", F.expr(f"(chromstart div {cell}) * {cell}"))
    return dmr.pool(counts.withColumn("side", F.expr(by)), ["side", *dmr.POSITION])


#: Samples of odd number against those of even number: replicates of two sides.
SIDE = "case when cast(substring(sample_id, -1) as int) % 2 = 1 then 'a' else 'b' end"


def _sides(spark: SparkSession, d: str, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    pooled = materialize(_cells(spark, d, SIDE, cell))
    side = lambda s: pooled.where(F.col("side") == s).drop("side")
    return side("a"), side("b")


def c12_sites(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return _rounded(dmr.sites(a, b)).select(*dmr.POSITION, dmr.counts_text(F.col("a_counts")).alias("a_counts"), "a_total", dmr.counts_text(F.col("b_counts")).alias("b_counts"), "b_total", "score", "effect_size")


def c12_site_p_values(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    scored = dmr.sites(a, b)
    return dmr.with_p_values(scored, dmr.coverage_cap(a), dmr.coverage_cap(b)).select(*dmr.POSITION, "score", "effect_size", "map_p_value", "capped_effect_size")


def _site_scores(spark: SparkSession, d: str, cell: int = CELL) -> DataFrame:
    a, b = _sides(spark, d, cell)
    # one site per position: both strands together
    keys = ["chrom", "chromstart"]
    both = dmr.sites(a, b).groupBy(*keys).agg(F.lit(".").alias("strand"), *[F.sum(c).alias(c) for c in ("a_mod", "a_total", "b_mod", "b_total")])
    return both.withColumn("score", stats.llr_beta(F.col("a_mod"), F.col("a_total"), F.col("b_mod"), F.col("b_total")))


def c12_segments(spark: SparkSession, d: str) -> DataFrame:
    scored = _site_scores(spark, d)
    found = dmr.Segmenter(max_gap=SEGMENT_GAP, decay=SEGMENT_DECAY, block=20_000_000).segment(scored)
    return dmr.segment_rows(found, scored).withColumn("score", F.round("score", 6) + 0.0).withColumn("effect_size", F.round("effect_size", 9) + 0.0)


def a18_replicates(spark: SparkSession, d: str) -> DataFrame:
    """All samples pooled with balanced coverage."""
    out = dmr.pool(_cells(spark, d, "sample_id"), list(dmr.POSITION), balanced=True)
    return out.select(*dmr.POSITION, "total", dmr.counts_text(F.col("counts")).alias("counts"))


def a18_pooled(spark: SparkSession, d: str) -> DataFrame:
    out = dmr.pool(_cells(spark, d, "sample_id"), list(dmr.POSITION))
    return out.select(*dmr.POSITION, "total", dmr.counts_text(F.col("counts")).alias("counts"))


def _cg_windows(spark: SparkSession, d: str, n: int = WINDOW_N, span: int = SPAN):
    """Calls at CG, windows over them, and the extents of reads; positions are made once."""
    pos = read_positions(spark, d).where(calls.is_primary(F.col("flag")) & calls.is_mapped(F.col("flag"), F.col("chrom"), F.col("ref_pos")) & F.col("strand").isin("+", "-"))
    at_cg = F.coalesce((F.col("base") == "C") & (F.substring("ref_kmer", 3, 2) == "CG"), F.lit(False))
    pos = materialize(pos.select("read_id", "flag", "chrom", "ref_pos", "strand", "base", "probs", "kind", at_cg.alias("cg")))
    extents = pos.groupBy("read_id", "flag", "chrom").agg(F.min("ref_pos").alias("ref_start"), (F.max("ref_pos") + 2).alias("ref_end"))
    cg = pos.where("cg")
    wins = entropy.windows(cg.select("chrom", "strand", F.col("ref_pos").alias("pos")).distinct(), n, span)
    return calls.called(cg, THRESHOLDS), wins, extents


def w5_windows(spark: SparkSession, d: str) -> DataFrame:
    return _cg_windows(spark, d)[1]


def _entropy(spark: SparkSession, d: str, n: int, span: int, min_coverage: int) -> DataFrame:
    called, wins, extents = _cg_windows(spark, d, n, span)
    out = entropy.window_entropy(entropy.window_patterns(called, wins, extents, n), n, min_coverage)
    return out.withColumn("entropy", F.round("entropy", 9) + 0.0)


def c19_entropy_windows(spark: SparkSession, d: str) -> DataFrame:
    return _entropy(spark, d, WINDOW_N, SPAN, 1)


def c19_entropy_default(spark: SparkSession, d: str) -> DataFrame:
    """The usual windows: four positions within 50 bases, three reads."""
    return _entropy(spark, d, 4, 50, 3)


def c19_entropy_regions(spark: SparkSession, d: str) -> DataFrame:
    out = entropy.region_entropy(c19_entropy_windows(spark, d), regions(spark, d))
    for c in ("mean_entropy", "median_entropy", "mean_num_reads"):
        out = out.withColumn(c, F.round(c, 6))
    return out


def _truth(spark: SparkSession, d: str) -> DataFrame:
    """Regions of even number are taken to be 5mC, others canonical."""
    r = regions(spark, d)
    return r.select("chrom", "start", "end", "strand", F.when(F.regexp_extract("region_name", r"(\d+)$", 1).cast("int") % 2 == 0, "m").otherwise("-").alias("code"))


def _validated(spark: SparkSession, d: str) -> DataFrame:
    return validate.against_truth(read_positions(spark, d).where("base = 'C'"), _truth(spark, d))


def c14_confusion(spark: SparkSession, d: str) -> DataFrame:
    return validate.confusion(_validated(spark, d)).withColumn("percent", F.round("percent", 6))


def c14_accuracy(spark: SparkSession, d: str) -> DataFrame:
    out = validate.accuracy(validate.balance(_validated(spark, d)))
    return out.select("n", "n_kept", *[F.round(c, 6).alias(c) for c in ("raw_accuracy", "threshold", "filtered_accuracy")])


def a10_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Summary of calls at thresholds estimated from the data."""
    pos = read_positions(spark, d)
    return summary(pos, estimate_thresholds(pos)).select("base", "code", "pass_count", "fail_count")


QUERIES = {
    f.__name__: f
    for f in (
        c20_localize, c21_stats, c22_merge, c23_track, j11_containing, u4_interval_merge, a17_contradictions, c11_region_pair, c13_region_multi, c12_sites, c12_site_p_values,
        c12_segments, a18_replicates, a18_pooled, w5_windows, c19_entropy_windows, c19_entropy_default, c19_entropy_regions, c14_confusion, c14_accuracy, a10_thresholds,
    )
}

_CODE = "string_split(name, ',')[1]"
_IN = 'r.chrom = b.chrom and b.chromstart >= r.start and b.chromstart < r."end" and (r.strand = \'.\' or b.strand = \'.\' or r.strand = b.strand)'
_KNOWN = ", ".join(f"'{c}'" for c in BASE_OF_CODE)
_F = "(lgamma({0}) + lgamma({1}) - lgamma({0} + {1}))"


def _f(k: str, n: str) -> str:
    return "(" + _F.format(f"(0.5::double + 2 * ({k}))", f"(0.5::double + 2 * (({n}) - ({k})))") + " - " + _F.format(f"(0.5::double + ({k}))", f"(0.5::double + ({n}) - ({k}))") + ")"


def _best() -> str:
    return f"""best as (select sample_id, chrom, chromstart, strand, {_CODE} as code, max(struct_pack(v := valid_coverage, m := count_modified, c := count_canonical)) as b from bedmethyl
 where chrom is not null and chromstart is not null and strand is not null and name is not null and valid_coverage is not null and {_CODE} in ({_KNOWN}) group by all),
pc0 as (select sample_id, chrom, chromstart, strand, max(b.v) as total, sum(b.m)::bigint as n_mod from best group by all),
pc as (select * from pc0 where n_mod <= total),
cc as (select best.sample_id, chrom, chromstart, strand, code, b.m as n from best join pc using (sample_id, chrom, chromstart, strand))"""


def _ld(counts: str, factor: int) -> str:
    """ln beta of a list of counts."""
    return f"(list_sum(list_transform({counts}, lambda x: lgamma({factor} * x + 0.5::double))) - lgamma(list_sum(list_transform({counts}, lambda x: {factor} * x + 0.5::double))))"


def _score_sql(source: str, keys: str) -> str:
    """Scores from s(side, keys, code, n) and t(side, keys, total, n_mod)."""
    dirichlet = lambda c: f"({_ld(c, 2)} - {_ld(c, 1)})"
    return f"""{source},
al as (select distinct {keys} from s), cs as (select distinct {keys}, code from s),
lists as (select cs.*, coalesce(x.n, 0) as na, coalesce(y.n, 0) as nb, x.n is not null as ha, y.n is not null as hb from cs left join (select * from s where side = 'a') x using ({keys}, code) left join (select * from s where side = 'b') y using ({keys}, code)),
g as (select {keys}, list(na::double order by code) as la, list(nb::double order by code) as lb, count(*) filter (ha) as ca, count(*) filter (hb) as cb, count(*) as cu from lists group by {keys}),
z as (select g.*, ta.total as a_total, tb.total as b_total, ta.n_mod as a_mod, tb.n_mod as b_mod, list_append(la, (ta.total - ta.n_mod)::double) as xa, list_append(lb, (tb.total - tb.n_mod)::double) as xb
  from g join (select * from t where side = 'a') ta using ({keys}) join (select * from t where side = 'b') tb using ({keys}) where ta.total > 0 and tb.total > 0),
sc as (select *, case when greatest(ca, cb) = 0 then 0 when greatest(ca, cb) = 1 then case when cu = 1 then {_f("a_mod", "a_total")} + {_f("b_mod", "b_total")} - {_f("a_mod + b_mod", "a_total + b_total")} end
  else {dirichlet("xa")} + {dirichlet("xb")} - {dirichlet("list_transform(range(1, len(xa) + 1), lambda i: xa[i] + xb[i])")} end as score from z)"""


_RK = "chrom, start, \"end\", region_name, region_strand"
_REGION = f"""{_best()}, {REGIONS_SQL},
hits as (select b.sample_id, b.chrom, b.chromstart, b.strand, b.total, b.n_mod, r.start, r."end", r.region_name, r.strand as region_strand from pc b join regions r on {_IN}),
rt as (select sample_id, {_RK}, sum(total)::bigint as total, sum(n_mod)::bigint as n_mod from hits group by all),
rc as (select h.sample_id, {_RK}, code, sum(n)::bigint as n from hits h join cc using (sample_id, chrom, chromstart, strand) group by all)"""
_TEXT = "(select coalesce(string_agg(code || ':' || n, ',' order by code), '.') from s where side = '{0}' and {1})"


def _regions_sql(pairs: str) -> str:
    keys = "sample_a, sample_b, " + _RK
    source = f"""with {_REGION}, pr as ({pairs}),
s as (select 'a' as side, sample_a, sample_b, {_RK}, code, n from rc join pr on sample_id = sample_a union all select 'b', sample_a, sample_b, {_RK}, code, n from rc join pr on sample_id = sample_b),
t as (select 'a' as side, sample_a, sample_b, {_RK}, total, n_mod from rt join pr on sample_id = sample_a union all select 'b', sample_a, sample_b, {_RK}, total, n_mod from rt join pr on sample_id = sample_b),
tx as (select side, {keys}, string_agg(code || ':' || n, ',' order by code) as txt from s group by all)"""
    return f"""{_score_sql(source, keys)} select {keys}, round(score, 5) + 0.0 as score, x.txt as a_counts, a_total, y.txt as b_counts, b_total, round(a_mod / a_total, 5) as a_pct_modified, round(b_mod / b_total, 5) as b_pct_modified
from sc join (select * exclude (side) from tx where side = 'a') x using ({keys}) join (select * exclude (side) from tx where side = 'b') y using ({keys})"""


_POS = "chrom, chromstart, strand"


def _cells_sql(by: str) -> str:
    """pt(side, position, total, n_mod) and ct(side, position, code, n): sums of cells."""
    grid = f"(chromstart // {CELL}) * {CELL}"
    return f"""{_best()}, pt as (select {by} as side, chrom, {grid} as chromstart, strand, sum(total)::bigint as total, sum(n_mod)::bigint as n_mod from pc group by 1, 2, 3, 4),
ct as (select {by} as side, chrom, {grid} as chromstart, strand, code, sum(n)::bigint as n from cc group by 1, 2, 3, 4, 5)"""


_SIDE_SQL = "case when substring(sample_id, length(sample_id), 1)::int % 2 = 1 then 'a' else 'b' end"
_SITES = f"""with {_cells_sql(_SIDE_SQL)}, s as (select * from ct), t as (select * from pt),
tx as (select side, {_POS}, string_agg(code || ':' || n, ',' order by code) as txt from s group by all)"""
_W = f"""w0 as (select distinct chrom, strand, ref_pos as pos from m where (flag & 3328) = 0 and (flag & 4) = 0 and chrom is not null and ref_pos >= 0 and strand in ('+', '-') and base = 'C' and substring(ref_kmer, 3, 2) = 'CG'),
w1 as (select *, lead(pos) over (partition by chrom, strand order by pos) as nxt from w0),
w2 as (select chrom, strand, pos as start, nxt + 2 as "end", pos as p0, nxt as p1 from w1 where nxt + 2 - pos <= {SPAN})"""
_TRUTH = f"""tr as (select b.*, case when regexp_extract(r.region_name, '(\\d+)$', 1)::int % 2 = 0 then 'm' else '-' end as truth from c b join regions r on r.chrom = b.chrom and b.ref_pos >= r.start and b.ref_pos < r."end"
  and (r.strand = '.' or b.strand = '.' or r.strand = b.strand) where b.base = 'C')"""

_ENTROPY = f"""{CALLS_SQL}, {_W},
ext as (select read_id, flag, chrom, min(ref_pos) as rs, max(ref_pos) + 2 as re from m where (flag & 3328) = 0 and (flag & 4) = 0 and chrom is not null and ref_pos >= 0 and strand in ('+', '-') group by all),
ck as (select distinct {KEYS} from m where base = 'C' and substring(ref_kmer, 3, 2) = 'CG'),
cl as (select read_id, flag, chrom, strand, ref_pos as pos, case when kind = 'modified' then call_code else '-' end as st from c semi join ck on {" and ".join(f"c.{k} is not distinct from ck.{k}" for k in KEYS.split(", "))} where kind in ('modified', 'canonical') and base = 'C' and (flag & 3332) = 0),
h as (select chrom, strand, start, "end", read_id, flag, coalesce(max(st) filter (pos = p0), '*') as s0, coalesce(max(st) filter (pos = p1), '*') as s1
      from w2 join cl using (chrom, strand) join ext using (read_id, flag, chrom) where (pos = p0 or pos = p1) and rs <= start and re >= "end" group by all),
pat as (select chrom, strand, start, "end", s0, s1, count(*) as n from h group by all),
c0s as (select distinct chrom, strand, start, s0 as a from pat where s0 <> '*'), c1s as (select distinct chrom, strand, start, s1 as b from pat where s1 <> '*'),
fl as (select distinct chrom, strand, start, a, b from pat join c0s using (chrom, strand, start) join c1s using (chrom, strand, start) where (s0 = '*' or s0 = a) and (s1 = '*' or s1 = b)),
mt as (select *, n / count(*) over (partition by chrom, strand, start, s0, s1)::double as part from pat join fl using (chrom, strand, start) where (s0 = '*' or s0 = a) and (s1 = '*' or s1 = b)),
ps as (select chrom, strand, start, a, b, sum(part) as w from mt group by chrom, strand, start, a, b),
pr as (select *, w / sum(w) over (partition by chrom, strand, start) as p from ps),
en as (select chrom, strand, start, -sum(p * log2(p)) / {WINDOW_N} as entropy from pr group by chrom, strand, start),
nr as (select chrom, strand, start, "end", sum(n)::bigint as num_reads from pat group by all),
ew as (select chrom, start, "end", strand, round(entropy, 9) + 0.0 as entropy, num_reads from nr left join en using (chrom, strand, start))"""

_ESTIMATED = (
    CALLS_SQL.replace(threshold_sql(), "coalesce(v, 0)")
    .replace("from cls group by all)", "from cls left join th using (base) group by all)", 1)
    .replace("c0 as (select", f"th as (select base, quantile_cont(p, 0.1) as v from (select {KEYS}, max(p) as p from cls group by all) group by base having count(*) >= 2),\nc0 as (select", 1)
)

_STAY = f"(1 - ((least(gap, {SEGMENT_DECAY}) - 2)::double / ({SEGMENT_DECAY} - 2) * 0.8::double + 0.1::double))"
# the best path site by site, and back; l: of the chain's sites the last
_SEGMENTS = f"""with recursive {_cells_sql(_SIDE_SQL)},
bothn as (select chrom, chromstart, strand, a.total as ta, b.total as tb, a.n_mod as ma, b.n_mod as mb from (select * from pt where side = 'a') a join (select * from pt where side = 'b') b using ({_POS}) where a.total > 0 and b.total > 0),
site as (select chrom, chromstart as pos, sum(ma)::bigint as a_mod, sum(ta)::bigint as a_total, sum(mb)::bigint as b_mod, sum(tb)::bigint as b_total from bothn group by all),
sc as (select *, {_f("a_mod", "a_total")} + {_f("b_mod", "b_total")} - ({_f("(a_mod + b_mod)", "(a_total + b_total)")}) as score from site),
p0 as (select *, exp(-greatest(score, 0)) as p1, row_number() over (partition by chrom order by pos) as i, pos - lag(pos) over (partition by chrom order by pos) as gap, lead(pos) over (partition by chrom order by pos) - pos as ahead from sc),
st as materialized (select *, coalesce(gap, {SEGMENT_GAP}) >= {SEGMENT_GAP} as fresh, coalesce(ahead, {SEGMENT_GAP}) >= {SEGMENT_GAP} as l,
  0.3::double * (ln(case when p1 = 0 then 1e-5 else p1 end) - ln(0.01::double / 0.99::double)) as e0, -0.1::double * (ln(1 - case when p1 = 0 then 1e-5 else p1 end + 1e-5) - ln(0.01::double / 0.99::double)) as e1 from p0),
fw as (select chrom, i, 2 * ln(0.9::double) + e0 as v0, ln(0.9::double) + ln(0.1::double) + e1 as v1, 0 as b0, 0 as b1 from st where i = 1
  union all select st.chrom, st.i, case when fresh then 2 * ln(0.9::double) else greatest(v0 + ln(0.9::double), v1 + ln(1 - {_STAY})) end + e0, case when fresh then ln(0.9::double) + ln(0.1::double) else greatest(v0 + ln(0.1::double), v1 + ln({_STAY})) end + e1,
    case when not fresh and v1 + ln(1 - {_STAY}) > v0 + ln(0.9::double) then 1 else 0 end, case when not fresh and v1 + ln({_STAY}) > v0 + ln(0.1::double) then 1 else 0 end
  from fw join st on st.chrom = fw.chrom and st.i = fw.i + 1),
path as materialized (select st.*, v0, v1, b0, b1 from st join fw using (chrom, i)),
bw as (select chrom, i, case when v1 > v0 then 1 else 0 end as state, b0, b1, fresh from path where l
  union all select p.chrom, p.i, case when bw.state = 1 then bw.b1 else bw.b0 end, p.b0, p.b1, p.fresh from bw join path p on p.chrom = bw.chrom and p.i = bw.i - 1 where not bw.fresh),
g as (select *, sum(case when fresh then 1 else 0 end) over (partition by chrom order by i) as chain from path join (select chrom, i, state from bw) using (chrom, i)),
r as (select *, i - row_number() over (partition by chrom, chain, state order by i) as run from g where not l)
select chrom, min(pos) as start, max(pos) + 1 as "end", case state when 0 then 'same' else 'different' end as state, count(*) as num_sites, sum(a_mod)::bigint as a_mod, sum(a_total)::bigint as a_total, sum(b_mod)::bigint as b_mod, sum(b_total)::bigint as b_total,
  round({_f("sum(a_mod)", "sum(a_total)")} + {_f("sum(b_mod)", "sum(b_total)")} - ({_f("(sum(a_mod) + sum(b_mod))", "(sum(a_total) + sum(b_total))")}), 6) + 0.0 as score, round(sum(a_mod) / sum(a_total) - sum(b_mod) / sum(b_total), 9) + 0.0 as effect_size
from r group by chrom, chain, state, run"""

ORACLES = {
    "c12_segments": _SEGMENTS,
    "a10_thresholds": f"with {_ESTIMATED}, k as (select *, case when kind = 'filtered' then top_code else call_code end as code from c where kind <> 'nocall') "
    "select base, code, count(*) filter (kind <> 'filtered') as pass_count, count(*) filter (kind = 'filtered') as fail_count from k group by all",
    "c19_entropy_windows": f"with {_ENTROPY} select * from ew",
    "c19_entropy_regions": f"""with {_ENTROPY}, {REGIONS_SQL}
select r.chrom, r.start, r."end", r.region_name, ew.strand, round(avg(entropy), 6) as mean_entropy, round(quantile_cont(entropy, 0.5), 6) as median_entropy, min(entropy) as min_entropy, max(entropy) as max_entropy,
 round(avg(num_reads) filter (entropy is not null), 6) as mean_num_reads, min(num_reads) filter (entropy is not null) as min_num_reads, max(num_reads) filter (entropy is not null) as max_num_reads,
 count(entropy) as successful_window_count, count(*) filter (entropy is null) as failed_window_count
from ew join regions r on r.chrom = ew.chrom and ew.start >= r.start and ew.start < r."end" where ew."end" <= r."end" group by r.chrom, r.start, r."end", r.region_name, ew.strand""",
    "c20_localize": f"""with {REGIONS_SQL}, sl as (select r.chrom, (r.start + r."end") // 2 as mid, strand, size from regions r join contigs using (chrom)),
r as (select chrom, mid, strand, greatest(0, mid - {LOCAL_WINDOW} - 1) as start, least(mid + {LOCAL_WINDOW}, size) as "end" from sl)
select {_CODE} as code, mid - chromstart as "offset", sum(count_modified)::bigint as n_mod, sum(valid_coverage)::bigint as n_valid, round(100.0::double * sum(count_modified) / nullif(sum(valid_coverage), 0), 2) as percent
from bedmethyl b join r on {_IN} group by 1, 2""",
    "c21_stats": f"""with {REGIONS_SQL}, x as (select r.*, r.strand as region_strand, {_CODE} as code, count_modified as n, valid_coverage as v from bedmethyl b join regions r on {_IN} where valid_coverage >= 1 and {_CODE} in ('m', 'h', 'a'))
select chrom, start, "end", region_name, region_strand, """
    + ", ".join(f"coalesce(sum(n) filter (code = '{c}'), 0)::bigint as count_{c}, coalesce(sum(v) filter (code = '{c}'), 0)::bigint as count_valid_{c}, round(100.0::double * sum(n) filter (code = '{c}') / sum(v) filter (code = '{c}'), 2) as percent_{c}" for c in STAT_CODES)
    + " from x group by all",
    "c22_merge": "with g as (select chrom, chromstart, name, strand, " + ", ".join(f"coalesce(sum({c}), 0)::bigint as {c}" for c in COUNT_COLUMNS)
    + " from bedmethyl where chrom is not null and chromstart is not null and name is not null and strand is not null group by all) select *, count_modified + count_canonical + count_other_mod as valid_coverage, "
    "coalesce(round(100.0::double * count_modified / nullif(count_modified + count_canonical + count_other_mod, 0), 2), 0) as percent_modified from g",
    "c23_track": f"""with g as (select chrom, chromstart, strand, sum(count_modified) as n, max(valid_coverage) as cov from bedmethyl where {_CODE} in ('m', 'h') and chrom is not null and valid_coverage > 0 group by all)
select chrom, chromstart as start, chromstart + 1 as "end", round(case when strand = '-' then -1.0::double else 1.0 end * 100.0 * least(1.0::double, n / cov), 4) + 0.0 as value from g
qualify row_number() over (partition by chrom, chromstart order by cov desc, ascii(strand)) = 1""",
    "j11_containing": f"""with {MODS_SQL}, r as (select read_id, flag, chrom, min(ref_pos) as ref_start, max(ref_pos) + 1 as ref_end from m where (flag & 3328) = 0 and (flag & 4) = 0 and chrom is not null and ref_pos >= 0 group by all),
w as (select distinct chrom, (ref_start // 25 + 1) * 25 as start from r) select read_id, flag, chrom, start, start + 5 as "end" from r join w using (chrom) where ref_start <= start and ref_end >= start + 5""",
    "u4_interval_merge": """with i as (select chrom, greatest(0, chromstart - 500) as s, chromstart + 500 as e from bedmethyl where chrom is not null and chromstart is not null),
o as (select *, max(e) over (partition by chrom order by s, e rows between unbounded preceding and 1 preceding) as reach from i),
g as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by chrom order by s, e rows unbounded preceding) as run from o)
select chrom, min(s) as start, max(e) as "end", count(*) as n from g group by chrom, run""",
    "c11_region_pair": _regions_sql(f"select '{A}' as sample_a, '{B}' as sample_b"),
    "c13_region_multi": _regions_sql("select x.sample_id as sample_a, y.sample_id as sample_b from (select distinct sample_id from pc) x, (select distinct sample_id from pc) y where x.sample_id < y.sample_id"),
    "c12_sites": f"""{_score_sql(_SITES, _POS)} select {_POS}, x.txt as a_counts, a_total, y.txt as b_counts, b_total, round(score, 5) + 0.0 as score, round(a_mod / a_total - b_mod / b_total, 5) + 0.0 as effect_size
from sc join (select * exclude (side) from tx where side = 'a') x using ({_POS}) join (select * exclude (side) from tx where side = 'b') y using ({_POS})""",
    "a17_contradictions": f"with {_best()} select sample_id, chrom, chromstart, strand, min(b.v) as least_coverage, max(b.v) as most_coverage, sum(b.m)::bigint as n_mod from best group by all having min(b.v) <> max(b.v) or sum(b.m) > max(b.v)",
    "a18_pooled": f"with {_cells_sql('sample_id')}, t as (select {_POS}, sum(total)::bigint as total from pt group by all), s as (select {_POS}, code, sum(n)::bigint as n from ct group by all), "
    f"x as (select {_POS}, string_agg(code || ':' || n, ',' order by code) as counts from s group by all) select * from t join x using ({_POS})",
    "a18_replicates": f"""with {_cells_sql('sample_id')}, p as (select *, avg(total) over (partition by {_POS})::float as mean, count(*) over (partition by {_POS}) as k from pt),
t as (select {_POS}, sum(case when k > 1 then floor(mean)::bigint else total end)::bigint as total from p group by all),
s as (select {_POS}, code, sum(case when k > 1 then floor(n::float / total::float * mean)::bigint else n end)::bigint as n from ct join p using (side, chrom, chromstart, strand) group by all),
x as (select {_POS}, string_agg(code || ':' || n, ',' order by code) as counts from s group by all) select * from t join x using ({_POS})""",
    "w5_windows": f"""with {MODS_SQL}, {_W} select chrom, strand, start, "end", 0 as k, p0 as pos from w2 union all select chrom, strand, start, "end", 1, p1 from w2""",
    "c14_accuracy": f"""with {CALLS_SQL}, {REGIONS_SQL}, {_TRUTH},
v as (select truth, top_code as call, top_p as p, row_number() over (partition by truth order by top_p, top_code) as i, count(*) over (partition by truth) as total from tr where kind <> 'nocall'),
k as (select *, min(total) over () as least from v),
b as (select truth, call, p from k where total = least or floor((i * (least + 1) - 1) / total::double) > floor(((i - 1) * (least + 1) - 1) / total::double) and floor((i * (least + 1) - 1) / total::double) >= 1 and i * (least + 1) - 1 >= total),
o as (select p, row_number() over (order by p) - 1 as j, count(*) over () as n from b),
t as (select (max(case when j = floor((n - 1) * 0.1::double) then p end) * (1 - ((any_value(n) - 1) * 0.1::double - floor((any_value(n) - 1) * 0.1::double)))
            + max(case when j = ceil((n - 1) * 0.1::double) then p end) * ((any_value(n) - 1) * 0.1::double - floor((any_value(n) - 1) * 0.1::double))) - 1 / 512.0::double as threshold from o)
select count(*) as n, round(100.0::double * count(*) filter (truth = call) / count(*), 6) as raw_accuracy, round(max(threshold), 6) as threshold, count(*) filter (p > threshold) as n_kept,
  round(100.0::double * count(*) filter (truth = call and p > threshold) / count(*) filter (p > threshold), 6) as filtered_accuracy from b, t""",
    "c14_confusion": f"with {CALLS_SQL}, {REGIONS_SQL}, {_TRUTH}, g as (select truth, case when kind = 'nocall' then 'no_call' else top_code end as call, count(*) as n from tr group by all) select *, round(100.0::double * n / sum(n) over (partition by truth), 6) as percent from g",
}
