"""Queries on the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import langid, leaks, mixing, sample, select
from strandline.session import table

QUANTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
POINTS = 64
LEVELS = {
    "code": ["call_code"],
    "code_sample": ["call_code", "sample_id"],
    "code_day": ["call_code", "batch_day"],
    "code_sample_day": ["call_code", "sample_id", "batch_day"],
}
SAMPLE_RATE = 0.05


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of call_prob by call_code, with and without sample and day."""
    return select.percentiles(table(spark, d, "read_calls"), ["call_code", "sample_id", "batch_day"], "call_prob", list(QUANTILES), LEVELS, 0, 1)


def p1_daily_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The mergeable summary of each call_code, sample_id and batch_day."""
    return select.summaries(table(spark, d, "read_calls"), ["call_code", "sample_id", "batch_day"], "call_prob", POINTS, 0, 1)


def p1_combined(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each call_code, with and without sample_id, put together from the
    daily summaries alone."""
    daily = p1_daily_summaries(spark, d)
    whole = select.combine(daily, ["call_code"], list(QUANTILES), ["sample_id", "batch_day"]).withColumn("sample_id", F.lit(None).cast("string")).withColumn("level", F.lit("code"))
    return whole.unionByName(select.combine(daily, ["call_code", "sample_id"], list(QUANTILES), ["batch_day"]).withColumn("level", F.lit("code_sample")))


def p2_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    """The cutoff of mod_qual for each target, with the rows kept and dropped."""
    return select.cutoffs(table(spark, d, "read_mods"), table(spark, d, "keep_targets"), ["canonical_base", "mod_code"], "mod_qual", low=0, high=1)


def p4_sampled_reads(spark: SparkSession, d: str) -> DataFrame:
    """One row per sampled read of both tables."""
    tables = {t: table(spark, d, t) for t in ("read_calls", "read_mods")}
    return sample.sample_reads(tables, "read_id", SAMPLE_RATE, "batch_day")


def p4_sampled_calls(spark: SparkSession, d: str) -> DataFrame:
    """The rows of read_calls that belong to the sample; a probability that is no number is null."""
    rows = sample.sample_rows(table(spark, d, "read_calls"), "read_id", SAMPLE_RATE)
    prob = F.when(~F.isnan("call_prob"), F.col("call_prob").cast("double"))
    return rows.select("sample_key", "forward_read_position", "chrom", "ref_position", "call_code", prob.alias("call_prob"), "sample_id", "batch_day")


def p4_growth(spark: SparkSession, d: str) -> DataFrame:
    """Keys and sampled keys by day of first delivery."""
    return sample.growth({t: table(spark, d, t) for t in ("read_calls", "read_mods")}, "read_id", SAMPLE_RATE, "batch_day")


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every message and item with a similar window, and how much they have in common."""
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.found(p6_leaks(spark, d))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix, document by document, with the slot of the block it belongs to."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).documents


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share reached by each source."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).report()


_networks: dict[tuple[str, str], langid.ByteConvNet] = {}


def _network(spark: SparkSession, d: str):
    """The network of a corpus is trained once in an application."""
    docs = table(spark, d, "documents")
    key = (spark.sparkContext.applicationId, d)
    if key not in _networks:
        _networks[key] = langid.train(*langid.training_sample(docs))
    return docs, _networks[key]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The languages of messages whose label is missing or wrong, or that have several."""
    docs, net = _network(spark, d)
    cases = langid.documents(docs, net).where(F.col("status").isin("missing", "wrong", "mixed"))
    return cases.select("doc_id", F.explode("langs").alias("lang"))


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    """Language, confidence and state of the label of each message."""
    docs, net = _network(spark, d)
    return langid.documents(docs, net)


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of each passage of each message."""
    docs, net = _network(spark, d)
    return langid.segments(docs, net)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_percentiles,
        p1_daily_summaries,
        p1_combined,
        p2_cutoffs,
        p4_sampled_reads,
        p4_sampled_calls,
        p4_growth,
        p6_found,
        p6_leaks,
        p7_mix,
        p7_shares,
        p8_found,
        p8_documents,
        p8_segments,
    )
}

_USABLE = "{0} is not null and not isnan({0}) and {0} between 0 and 1"
_QS = ", ".join(f"({q}::double)" for q in QUANTILES)
_DAY = "call_code, sample_id, batch_day"
_SAME_DAY = " and ".join(f"v.{c} is not distinct from w.{c}" for c in _DAY.split(", "))
_SUMMARY = f"""
v as (select {_DAY}, call_prob::double as value,
             row_number() over (partition by {_DAY} order by call_prob) as rank,
             count(*) over (partition by {_DAY}) as n
      from read_calls where {_USABLE.format("call_prob")}),
wanted as (select distinct {_DAY}, n, greatest(1, ceil(i * n / {POINTS}.0 - 1e-9))::bigint as rank
           from (select distinct {_DAY}, n from v), (select unnest(range({POINTS} + 1)) as i)),
s as (select v.call_code, v.sample_id, v.batch_day, v.n, v.rank, v.value,
             v.rank - coalesce(lag(v.rank) over (partition by v.call_code, v.sample_id, v.batch_day order by v.rank), 0) as weight
      from v join wanted w on {_SAME_DAY} and v.rank = w.rank)"""


def _combined_sql(level: str, sample_id: str) -> str:
    """Daily summaries put together; sample_id is the column, or null for all samples."""
    return f"""
select '{level}' as level, t.call_code, t.sample_id, t.parts, t.n, q, greatest(1, ceil(q * t.n - 1e-9))::bigint as rank, min(p.value) as value, t.rank_error
from (select call_code, {sample_id} as sample_id, sum(n)::bigint as n, sum(gap)::bigint as rank_error, count(*) as parts
      from (select {_DAY}, max(n) as n, max(weight) - 1 as gap from s group by all) group by 1, 2) t, (values {_QS}) as x(q),
     (select call_code, {sample_id} as sample_id, value, sum(sum(weight)) over (partition by call_code, {sample_id} order by value) as upto from s group by 1, 2, 3) p
where t.call_code is not distinct from p.call_code and t.sample_id is not distinct from p.sample_id and p.upto >= greatest(1, ceil(q * t.n - 1e-9))
group by all"""


_KEY = "lower(trim(read_id))"
_IN = f"substring(md5('{sample.SALT}/' || {_KEY}), 1, 13) < '{int(SAMPLE_RATE * 16**13):013x}' and {_KEY} <> ''"

ORACLES: dict[str, str] = {
    "p1_percentiles": f"""
with v as (select call_code, sample_id, batch_day, call_prob::double as value from read_calls where {_USABLE.format("call_prob")}),
l as (select 'code' as level, call_code, null as sample_id, null::date as batch_day, value from v
      union all select 'code_sample', call_code, sample_id, null::date, value from v
      union all select 'code_day', call_code, null, batch_day, value from v
      union all select 'code_sample_day', call_code, sample_id, batch_day, value from v),
r as (select *, row_number() over (partition by level, call_code, sample_id, batch_day order by value) as rank,
      count(*) over (partition by level, call_code, sample_id, batch_day) as n from l)
select level, call_code, sample_id, batch_day, n, q, rank, value, 0::bigint as rank_error
from r, (values {_QS}) as t(q) where rank = greatest(1, ceil(q * n - 1e-9))::bigint""",
    "p1_daily_summaries": f"with {_SUMMARY} select * from s",
    "p1_combined": f"with {_SUMMARY} {_combined_sql('code', 'null::varchar')} union all {_combined_sql('code_sample', 'sample_id')}",
    "p2_cutoffs": f"""
with g as (select k.canonical_base, k.mod_code, k.keep_fraction, r.mod_qual::double as v, r.chrom is not null or r.flag is not null as there,
                  {_USABLE.format("r.mod_qual")} as ok
           from keep_targets k left join read_mods r using (canonical_base, mod_code)),
n as (select canonical_base, mod_code, keep_fraction, count(*) filter (ok) as n, count(*) filter (there and not coalesce(ok, false)) as n_unusable from g group by all),
d as (select canonical_base, mod_code, v, count(*) as c from g where ok group by all),
c as (select canonical_base, mod_code, v as cutoff, sum(c) over (partition by canonical_base, mod_code order by v desc) as kept from d
      union all select canonical_base, mod_code, null, 0 from n),
b as (select n.*, c.cutoff, c.kept::bigint as n_kept, row_number() over (partition by canonical_base, mod_code, keep_fraction order by abs(c.kept - n.keep_fraction * n.n), c.kept desc) as o
      from n join c using (canonical_base, mod_code))
select canonical_base, mod_code, keep_fraction, cutoff, n, n_kept, n - n_kept as n_dropped, n_unusable,
       case when n > 0 then n_kept::double / n end as kept_share from b where o = 1""",
    "p4_sampled_reads": f"""
with a as (select {_KEY} as sample_key, batch_day, 1 as c, 0 as m from read_calls where {_IN}
           union all select {_KEY}, batch_day, 0, 1 from read_mods where {_IN})
select sample_key, min(batch_day) as first_day, max(batch_day) as last_day, sum(c)::bigint as n_read_calls, sum(m)::bigint as n_read_mods,
       ('0x' || substring(md5('{sample.SALT}/' || sample_key), 1, 13))::bigint / 16.0::double ** 13 as place
from a group by sample_key""",
    "p4_sampled_calls": f"""
select {_KEY} as sample_key, forward_read_position, chrom, ref_position, call_code, case when not isnan(call_prob) then call_prob::double end as call_prob, sample_id, batch_day
from read_calls where {_IN}""",
    "p4_growth": f"""
with a as (select {_KEY} as k, min(batch_day) as day from (select read_id, batch_day from read_calls union all select read_id, batch_day from read_mods)
           where {_KEY} <> '' and batch_day is not null group by 1),
b as (select day, count(*) as new_keys, count(*) filter (substring(md5('{sample.SALT}/' || k), 1, 13) < '{int(SAMPLE_RATE * 16**13):013x}') as new_selected from a group by day)
select day, new_keys, new_selected, sum(new_keys) over (order by day)::bigint as keys, sum(new_selected) over (order by day)::bigint as selected from b""",
}
