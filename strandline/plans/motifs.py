"""Queries on motifs, k-mers and tags."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import tags
from strandline.functions.seq import Motif
from strandline.operators import calls, motifs, pileup, rewrite, validate
from strandline.plans.binding import THRESHOLDS, read_positions
from strandline.schema import BASE_OF_CODE
from strandline.session import materialize, release, table

MOTIFS = [Motif("CG", 0), Motif("DRACH", 2), Motif("CHH", 0), Motif("GATC", 1)]
TESTED = [("CG", 0, "m"), ("CHH", 0, "m"), ("CHG", 0, "h"), ("DRACH", 2, "a"), ("C", 0, "m")]
SEARCHES = 6  # at a time


def sequences(spark: SparkSession, d: str) -> DataFrame:
    """Sequences from the letters A, C, G, T of the documents."""
    return table(spark, d, "documents").select("doc_id", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))


def c15_motif_bed(spark: SparkSession, d: str) -> DataFrame:
    return motifs.motif_hits(sequences(spark, d), MOTIFS, "doc_id")


def _levels(spark: SparkSession, d: str) -> DataFrame:
    """K-mers of five around each position of the pileup."""
    pos = read_positions(spark, d)
    rows = pileup.pileup(pos.withColumn("kmer", F.col("ref_kmer")), THRESHOLDS, ("kmer",))
    return motifs.kmer_levels(rows, min_coverage=1)


def a29_kmer_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d)


def a32_base_counts(spark: SparkSession, d: str) -> DataFrame:
    return motifs.base_counts(_levels(spark, d))


def c18_evaluate(spark: SparkSession, d: str) -> DataFrame:
    out = motifs.evaluate(_levels(spark, d), TESTED, 2)
    return out.withColumn("frac", F.round("frac", 9)).withColumn("log_odds", F.round("log_odds", 6))


def m1_fixed_seeds(spark: SparkSession, d: str) -> DataFrame:
    return motifs.fixed_seeds(_levels(spark, d), 2, (1, 2), 0.5).withColumn("log_odds", F.round("log_odds", 6))


def _search(levels: DataFrame, code: str) -> motifs.Search:
    return motifs.Search(levels.where(F.col("code") == code), 2, 5, BASE_OF_CODE[code], min_sites=20, min_frac=0.5, min_log_odds=0.3, seed_log_odds=0.5)


def _found(spark: SparkSession, d: str, find: Callable[[motifs.Search], list[motifs.Masks]]) -> DataFrame:
    """What ``find`` finds for each code of the k-mer table, several codes at a time:
    a search is a chain of short jobs."""
    levels = materialize(_levels(spark, d))
    codes = sorted(r["code"] for r in levels.select("code").distinct().collect())

    def rows(code: str) -> list[tuple]:
        s = _search(levels, code)
        out = [(code, *r) for r in s.table(find(s))]
        release(s.kmers)
        return out

    with ThreadPoolExecutor(SEARCHES) as pool:
        found = [r for part in pool.map(rows, codes) for r in part]
    release(levels)
    return spark.createDataFrame(found, "code string, motif string, offset int, high long, low long, frac double")


def c16_search(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, lambda s: s.run((1, 1)))


def c17_refine(spark: SparkSession, d: str) -> DataFrame:
    """The focus base of each code before G and before H, refined."""
    starts = lambda s: [motifs.masks_of(s.base + after, 0) for after in "GH"]
    return _found(spark, d, lambda s: motifs.merge([s.refine(m) for m in starts(s)]))


def a31_primary_base(spark: SparkSession, d: str) -> DataFrame:
    return motifs.primary_base(table(spark, d, "read_mods").where("mod_code is not null").select(F.col("mod_code").alias("code"), F.col("canonical_base").alias("base"))).withColumn("share", F.round("share", 9))


def _tagged_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads whose sequence comes from a document and whose calls lie on every CG."""
    seqs = sequences(spark, d).where("length(seq) >= 10")
    hits = motifs.motif_hits(seqs, [Motif("CG", 0)], "doc_id").where("strand = '+'")
    p = (F.col("pos") % 256 + F.lit(0.5)) / 256
    own = hits.select(F.col("doc_id").cast("string").alias("read_id"), F.lit(0).alias("flag"), F.lit("+").alias("mod_strand"), F.lit("C").alias("base"), F.col("pos").cast("int").alias("fwd_pos"), F.create_map(F.lit("m"), p).alias("probs"))
    reads = seqs.select(F.col("doc_id").cast("string").alias("read_id"), F.lit(0).alias("flag"), F.concat(F.lit("doc"), F.col("doc_id") % 7).alias("chrom"), F.lit(100).cast("long").alias("pos"), F.concat(F.length("seq"), F.lit("M")).alias("cigar"), "seq")
    return tags.encode_reads(reads, own)


def f2_tag_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Tags written from calls and decoded again."""
    return tags.decode_reads(_tagged_reads(spark, d)).select(F.col("read_id").cast("long").alias("doc_id"), "fwd_pos", "ref_pos", F.round(F.col("probs")["m"], 9).alias("p"))


def c4_update_tags(spark: SparkSession, d: str) -> DataFrame:
    """The mode made implicit: bases without a call become canonical by inference."""
    reads = _tagged_reads(spark, d).withColumn("mm", tags.update_mode(F.col("mm"), "."))
    return tags.decode_reads(reads).groupBy(F.col("read_id").cast("long").alias("doc_id"), "inferred").agg(F.count("*").alias("n"), F.round(F.sum(F.col("probs")["m"]), 6).alias("p"))


def c3_adjust_reads(spark: SparkSession, d: str) -> DataFrame:
    """From tags to tags: m becomes h, calls near the ends go; decoded again."""
    reads = rewrite.adjust_reads(_tagged_reads(spark, d), convert=[("m", "h")], edge=(10, 10))
    return tags.decode_reads(reads).select(F.col("read_id").cast("long").alias("doc_id"), "fwd_pos", F.round(F.col("probs")["h"], 9).alias("p"))


def c5_call_reads(spark: SparkSession, d: str) -> DataFrame:
    """From tags to tags: the called class of each position."""
    reads = rewrite.call_reads(_tagged_reads(spark, d), THRESHOLDS)
    return tags.decode_reads(reads).select(F.col("read_id").cast("long").alias("doc_id"), "fwd_pos", F.round(F.col("probs")["m"], 9).alias("p"))


def _gapped_reads(spark: SparkSession, d: str) -> DataFrame:
    """Tagged reads; those of even number and over 40 bases have five deleted after the 20th."""
    cut = (F.col("read_id").cast("long") % 2 == 0) & (F.length("seq") > 40)
    return _tagged_reads(spark, d).withColumn("cigar", F.when(cut, F.concat(F.lit("20M5D"), F.length("seq") - 20, F.lit("M"))).otherwise(F.col("cigar")))


def c1_pileup_deletions(spark: SparkSession, d: str) -> DataFrame:
    """The pileup of tagged reads, deleted bases counted."""
    reads = _gapped_reads(spark, d)
    pos = tags.to_positions(tags.decode_reads(reads))
    return pileup.to_bedmethyl(pileup.pileup(pos, THRESHOLDS, deletions=calls.deletions(reads)))


def j10_uncalled(spark: SparkSession, d: str) -> DataFrame:
    """What reads show at truth positions (every seventh) for which they have no call."""
    reads = _gapped_reads(spark, d)
    called = tags.to_positions(tags.decode_reads(reads)).select("read_id", "flag", "chrom", "ref_pos", "strand")
    spots = spark.range(100, 401, 7).select(F.col("id").alias("pos"), F.lit("+").alias("strand"), F.when(F.col("id") % 2 == 0, "m").otherwise("-").alias("code"))
    truth = spots.withColumn("chrom", F.explode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.concat(F.lit("doc"), i))))
    return validate.uncalled(reads, called, truth).groupBy("truth", "status").agg(F.count("*").alias("n"))


def _odd_reads(spark: SparkSession, d: str) -> DataFrame:
    """Tagged reads of which most are changed or damaged, by the read's number."""
    reads, k = _tagged_reads(spark, d), F.col("read_id").cast("long") % 8
    mm = F.when(k == 1, tags.update_mode(F.col("mm"), ".")).when(k == 2, F.lit(None).cast("string")).when(k == 6, F.concat(F.lit("X"), "mm")).when(k == 7, F.regexp_replace("mm", "m", "hm")).otherwise(F.col("mm"))
    ml = F.when(k == 4, F.concat("ml", F.array(F.lit(7)))).when(k == 5, F.slice("ml", F.lit(1), F.size("ml") - 1)).when(k == 7, F.flatten(F.transform("ml", lambda x: F.array(F.lit(0), x)))).otherwise(F.col("ml"))
    return reads.withColumn("ml", F.when(F.col("ml").isNotNull(), ml)).withColumn("mm", mm).withColumn("mn", F.when(k == 3, F.col("mn") + 1).otherwise(F.col("mn")))


def a34_modified_bases(spark: SparkSession, d: str) -> DataFrame:
    return tags.modified_bases(_odd_reads(spark, d))


def c10_repair(spark: SparkSession, d: str) -> DataFrame:
    """Reads trimmed by 20 bases in front and 10 behind get the tags of the whole read."""
    whole = _tagged_reads(spark, d)
    part = whole.where("length(seq) > 60").withColumn("seq", F.expr("substring(seq, 21, length(seq) - 30)"))
    return tags.repair(whole, part).select(F.col("read_id").cast("long").alias("doc_id"), F.coalesce("error", F.lit("ok")).alias("state"), F.coalesce(F.size("ml"), F.lit(0)).alias("n_calls"))


def c24_check_tags(spark: SparkSession, d: str) -> DataFrame:
    return tags.census(tags.check_tags(_odd_reads(spark, d))).withColumn("percent", F.round("percent", 6))


QUERIES = {
    f.__name__: f
    for f in (c15_motif_bed, a29_kmer_levels, a32_base_counts, c18_evaluate, m1_fixed_seeds, c16_search, c17_refine, a31_primary_base, f2_tag_roundtrip, c4_update_tags, c3_adjust_reads, c5_call_reads, c1_pileup_deletions, j10_uncalled, c10_repair, c24_check_tags, a34_modified_bases)
}


def _levels_sql() -> str:
    from strandline.plans.binding import CALLS_SQL, KEYS
    from strandline.plans.reads import _bed_sql

    keyed = CALLS_SQL.replace(KEYS, "ref_kmer, " + KEYS).replace("max(r.ref_kmer) as ref_kmer,", "max(r.ref_kmer) over (partition by 1) as unused_kmer,")
    keyed = keyed.replace("max(r.ref_kmer) over (partition by 1) as unused_kmer,", "").replace("m0 as (select r.read_id", "m0 as (select max(r.ref_kmer) as ref_kmer, r.read_id")
    bed = _bed_sql(keyed, "ref_kmer, chrom, ref_pos, strand", show="ref_kmer,")
    return f"""bed as ({bed}),
lv as (select case when count_modified / valid_coverage <= 0.2 then 'low' when count_modified / valid_coverage > 0.6 then 'high' else 'mid' end as level, ref_kmer as kmer, name as code, count(*) as n
       from bed where regexp_full_match(ref_kmer, '[ACGT]+') group by all)"""


_LEVELS = _levels_sql()
_RE = {"CG": "..CG.", "CHH": "..C[ACT][ACT]", "CHG": "..C[ACT]G", "DRACH": "[AGT][AG]AC[ACT]", "C": "..C.."}
_SEQ = "seqs as (select doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') as seq from documents)"

#: seq0: reads; l: their calls at CG, with the place on the reference of a read that may have a gap.
_CALLED = f"""{_SEQ}, seq0 as (select *, 'doc' || doc_id % 7 as chrom, doc_id % 2 = 0 and length(seq) > 40 as cut from seqs where length(seq) >= 10),
l0 as (select *, unnest(range(length(seq))) as i from seq0),
l as (select *, ((i % 256) + 0.5::double) / 256 as p, 100 + i + case when cut and i >= 20 then 5 else 0 end as ref_pos from l0 where substring(seq, i + 1, 2) = 'CG')"""


def _evaluate_sql() -> str:
    parts = []
    for m, o, c in TESTED:
        hit = f"regexp_full_match(kmer, '{_RE[m]}')"
        n = lambda level, h: f"coalesce(sum(n) filter (code = '{c}' and level = '{level}' and {h}), 0)::bigint"
        parts.append(f"select '{m}' as motif, {o} as \"offset\", '{c}' as code, {n('high', hit)} as high, {n('low', hit)} as low, {n('mid', hit)} as mid, {n('high', 'not ' + hit)} as nh, {n('low', 'not ' + hit)} as nl from lv")
    return (
        f"with {_LEVELS}, e as (" + " union all ".join(parts) + ") select motif, \"offset\", code, high, low, mid, round(high / nullif(high + low, 0), 9) as frac, "
        "round(case when low * nh = 0 and high * nl = 0 then 0.0::double when low * nh = 0 then 'inf'::double when high * nl = 0 then '-inf'::double else log2((high * nl)::double / (low * nh)::double) end, 6) as log_odds from e"
    )


ORACLES = {
    "c15_motif_bed": f"with {_SEQ}, l as (select doc_id, seq, unnest(range(1, length(seq) + 1)) as i from seqs) "
    + " union all ".join(
        f"select doc_id, '{m.raw}' as motif, {m.offset} as \"offset\", i - 1 + {o} as pos, '{s}' as strand from l where regexp_full_match(substring(seq, i, {m.length}), '{p}')"
        for m in MOTIFS
        for s, o, p in (("+", m.offset, m.pattern), ("-", m.reverse_offset, m.reverse_pattern))
    ),
    "a29_kmer_levels": f"with {_LEVELS} select * from lv",
    "a32_base_counts": f"with {_LEVELS}, p as (select *, unnest(range(5)) as place from lv) select level, code, place, substring(kmer, place + 1, 1) as base, sum(n)::bigint as n from p group by all",
    "c18_evaluate": _evaluate_sql(),
    "m1_fixed_seeds": f"with {_LEVELS}, s as (select code, substring(kmer, 2, 4) as slice, coalesce(sum(n) filter (level = 'low'), 0)::bigint as low, coalesce(sum(n) filter (level = 'high'), 0)::bigint as high from lv group by all), "
    "t as (select *, sum(low) over (partition by code) as tl, sum(high) over (partition by code) as th from s) "
    "select code, slice, high, low, round(log2((high * tl)::double / (low * th)::double), 6) as log_odds from t where low > 0 and high > 0 and log2((high * tl)::double / (low * th)::double) >= 0.5",
    "a31_primary_base": "with g as (select mod_code as code, canonical_base as base, count(*) as n from read_mods where mod_code is not null and canonical_base is not null group by all) "
    "select code, arg_max(base, n * 1000 - ascii(base)) as base, round(max(n) / sum(n), 9) as share, count(*) > 1 as conflict from g group by code",
    "f2_tag_roundtrip": f"with {_SEQ}, l as (select doc_id, seq, unnest(range(length(seq))) as i from seqs where length(seq) >= 10) select doc_id, i as fwd_pos, 100 + i as ref_pos, round(((i % 256) + 0.5::double) / 256, 9) as p from l where substring(seq, i + 1, 2) = 'CG'",
    "c10_repair": f"with {_SEQ}, l as (select doc_id, seq, substring(seq, 21, length(seq) - 30) as part from seqs where length(seq) > 60), "
    "h as (select doc_id, seq, part, contains(seq, 'CG') as tagged, strpos(seq, part) as at, strpos(substring(seq, strpos(seq, part) + 1), part) as again from l), "
    "s as (select doc_id, case when not tagged then 'no donor' when again > 0 then 'more than once in the donor' else 'ok' end as state, substring(seq, 21, length(part) + 1) as shown from h) "
    "select doc_id, state, case when state = 'ok' then (length(shown) - length(replace(shown, 'CG', ''))) // 2 else 0 end as n_calls from s",
    "c24_check_tags": f"with {_SEQ}, l as (select doc_id % 8 as k, contains(seq, 'CG') as tagged from seqs where length(seq) >= 10), "
    "g as (select case when not tagged or k = 2 then 'no tags' when k = 3 then 'length differs from MN' when k = 4 then 'too many qualities' when k = 5 then 'too few qualities' when k = 6 then 'malformed tag' end as error, "
    "case when k = 1 then 'C+m.' when k = 7 then 'C+hm?' else 'C+m?' end as header from l), "
    "n as (select case when error is null then 'header' else 'error' end as kind, coalesce(error, header) as name, count(*) as n from g group by all) select *, round(100.0::double * n / sum(n) over (partition by kind), 6) as percent from n",
    "a34_modified_bases": f"with {_SEQ}, l as (select doc_id % 8 as k from seqs where length(seq) >= 10 and contains(seq, 'CG') and doc_id % 8 not in (2, 6)), "
    "e as (select '+' as strand, 'C' as base, unnest(case when k = 7 then ['h', 'm'] else ['m'] end) as code, case when k = 1 then '.' else '?' end as mode from l) select *, count(*) as n from e group by all",
    "c4_update_tags": f"with {_SEQ}, l as (select doc_id, seq, unnest(range(length(seq))) as i from seqs where length(seq) >= 10 and contains(seq, 'CG')) select doc_id, substring(seq, i + 1, 2) <> 'CG' as inferred, count(*) as n, "
    "round(sum(case when substring(seq, i + 1, 2) = 'CG' then ((i % 256) + 0.5::double) / 256 else 0 end), 6) as p from l where substring(seq, i + 1, 1) = 'C' group by 1, 2",
    "c3_adjust_reads": f"with {_CALLED} select doc_id, i as fwd_pos, round(p, 9) as p from l where i >= 10 and i < length(seq) - 10 and length(seq) > 10",
    "c5_call_reads": f"with {_CALLED} select doc_id, i as fwd_pos, round(case when p >= 0.7 then 255.5::double else 0.5::double end / 256, 9) as p from l where p >= 0.7 or 1 - p >= 0.7",
    "c1_pileup_deletions": f"""with {_CALLED}, r as (select distinct doc_id, chrom from seq0 where cut), x as (select chrom, ref_pos, count(*) filter (p >= 0.7) as n_mod, count(*) filter (p < 0.7 and 1 - p >= 0.7) as n_can, count(*) filter (p < 0.7 and 1 - p < 0.7) as n_fail from l group by all),
y as (select x.*, case when ref_pos between 120 and 124 then (select count(*) from r where r.chrom = x.chrom) else 0 end as n_delete from x where n_mod + n_can > 0)
select chrom, ref_pos as "chromStart", ref_pos + 1 as "chromEnd", 'm' as name, n_mod + n_can as score, '+' as strand, ref_pos as "thickStart", ref_pos + 1 as "thickEnd", '255,0,0' as color, n_mod + n_can as valid_coverage,
 round(100.0::double * n_mod / (n_mod + n_can), 2) as percent_modified, n_mod as count_modified, n_can as count_canonical, 0::bigint as count_other_mod, n_delete as count_delete, n_fail as count_fail, 0::bigint as count_diff, 0::bigint as count_nocall from y""",
    "j10_uncalled": f"""with {_CALLED}, t as (select unnest(range(100, 401, 7)) as pos), x as (select seq, pos, pos % 2 = 0 as m, cut, case when not cut or pos < 120 then pos - 100 when pos < 125 then -1 else pos - 105 end as q
  from seq0, t where contains(seq, 'CG') and pos < 100 + length(seq) + case when cut then 5 else 0 end),
y as (select case when m then 'm' else '-' end as truth, case when q < 0 then 'deletion' when substring(seq, q + 1, 1) = 'C' then 'no_call' else 'mismatch ' || substring(seq, q + 1, 1) end as status from x where q < 0 or substring(seq, q + 1, 2) <> 'CG')
select *, count(*) as n from y group by all""",
}
