import pytest
from pyspark.sql import functions as F

from strandline.functions import probs as P
from strandline.functions import tags
from strandline.functions.seq import Motif
from strandline.operators import calls, pileup, reference
from strandline.operators.motifs import motif_hits
from strandline.sources import readers, writers
from strandline.streaming import calls as stream
from tests.conftest import rows

T = P.Thresholds(0.5)


def read_mods(spark, data):
    """data: read_id, position, strand, kmer, code, probability[, flag]"""
    full = [(r, 7, p, "c1", "+", s, s, 0, 0, 20, q, code, 30, k, k, base, base, False, flag, "smp", None, None) for r, p, s, k, code, q, base, flag in data]
    schema = (
        "read_id string, forward_read_position int, ref_position long, chrom string, mod_strand string, ref_strand string, ref_mod_strand string, fw_soft_clipped_start int, "
        "fw_soft_clipped_end int, read_length int, mod_qual float, mod_code string, base_qual int, ref_kmer string, query_kmer string, canonical_base string, modified_primary_base string, "
        "inferred boolean, flag int, sample_id string, batch_day date, loaded_at timestamp"
    )
    return spark.createDataFrame(full, schema)


DATA = [
    ("a", 10, "+", "AACGA", "m", 0.75, "C", 0),
    ("a", 10, "+", "AACGA", "h", 0.125, "C", 0),
    ("b", 10, "+", "AACGA", "m", 0.25, "C", 0),
    ("c", 10, "+", "AACGA", "m", 0.375, "C", 0),
    ("c", 10, "+", "AACGA", "h", 0.375, "C", 0),
    ("d", 10, "+", "AACGA", "m", None, "C", 0),
    ("e", 10, "+", "AAAGA", "a", 0.875, "A", 0),
    ("f", 11, "-", "AACGA", "m", 0.75, "C", 16),
    ("g", 10, "+", "AACGA", "m", 0.75, "C", 1024),
    ("h", 10, "+", "AACGA", "m", 0.75, "C", 4),
    ("i", 10, "+", "AACGA", "x", 0.75, "C", 0),
    ("j", 10, "+", "AACGA", "m", 0.75, "C", 0),
    ("j", 10, "+", "AACGA", "h", 0.75, "C", 0),
    (None, 10, "+", "AACGA", "m", 0.75, "C", 0),
]


def test_pileup(spark):
    df = read_mods(spark, DATA)
    bed = pileup.to_bedmethyl(pileup.pileup(calls.positions(df), T))
    got = {(r["chromStart"], r["strand"], r["name"]): r for r in bed.collect()}
    m = got[10, "+", "m"]
    # a: m; b: canonical; c: no class passes; d: no call; e: another base; j contradicts itself
    assert (m["count_modified"], m["count_canonical"], m["count_other_mod"], m["count_fail"], m["count_nocall"], m["count_diff"]) == (1, 1, 0, 1, 1, 1)
    assert m["valid_coverage"] == 2 and m["percent_modified"] == 50.0
    h = got[10, "+", "h"]
    assert (h["count_modified"], h["count_other_mod"]) == (0, 1)
    assert got[10, "+", "a"]["count_modified"] == 1 and (11, "-", "m") in got and (11, "-", "h") not in got
    for r in bed.collect():
        assert r["score"] == r["valid_coverage"] == r["count_modified"] + r["count_canonical"] + r["count_other_mod"] >= 1
    doubled = pileup.to_bedmethyl(pileup.pileup(calls.positions(df.unionByName(df)), T))
    assert rows(doubled) == rows(bed)
    assert pileup.pileup(calls.positions(df.limit(0)), T).count() == 0


def test_combined(spark):
    pos = calls.positions(read_mods(spark, DATA))
    both = pileup.pileup(pos, T, combine_mods=True)
    assert {(r["ref_pos"], r["code"]): r["n_mod"] for r in both.collect()} == {(10, "C"): 1, (10, "A"): 1, (11, "C"): 1}
    cg = pileup.pileup(pos.where("base = 'C'"), T, combine_strands={"C": 1})
    (r,) = [r for r in cg.collect() if r["code"] == "m"]
    assert (r["ref_pos"], r["strand"], r["n_mod"], r["valid_coverage"]) == (10, ".", 2, 3)


def test_call_mods_give_the_same_pileup(spark):
    pos = calls.positions(read_mods(spark, DATA)).where("kind = 'call'")
    keep = ["ref_pos", "strand", "base", "code", "n_mod", "n_canonical", "n_other"]
    assert rows(pileup.pileup(calls.call_mods(pos, T), T), *keep) == rows(pileup.pileup(pos, T), *keep)


def test_hemi(spark):
    data = [("a", 10, "+", "AACGA", "m", 0.75, "C", 0), ("a", 11, "-", "AACGA", "m", 0.25, "C", 0), ("b", 10, "+", "AACGA", "m", 0.75, "C", 0), ("c", 10, "+", "AACGA", "m", 0.25, "C", 0), ("c", 11, "-", "AACGA", "m", 0.125, "C", 0)]
    got = {r["pattern"]: r for r in pileup.pileup_hemi(calls.positions(read_mods(spark, data)), T).collect()}
    assert set(got) == {"m,-,C", "-,-,C"}
    r = got["m,-,C"]
    assert (r["n"], r["n_canonical"], r["n_other"], r["n_nocall"], r["valid_coverage"]) == (1, 1, 0, 1, 2)


def test_partition_key(spark):
    df = spark.createDataFrame([("x", None), (None, None), ("x", "y")], "a string, b string")
    assert [r["k"] for r in df.select(pileup.partition_key(F.col("a"), F.col("b")).alias("k")).collect()] == ["x_missing", "ungrouped", "x_y"]


def test_focus_and_reference(spark):
    pos = calls.positions(read_mods(spark, DATA))
    ref = spark.createDataFrame([("c1", "A" * 10 + "CGA")], "chrom string, seq string")
    one = reference.focus(pos, motif_hits(ref, [Motif("CG", 0)]))
    assert {(r["ref_pos"], r["strand"], r["motif_label"]) for r in one.collect()} == {(10, "+", None), (11, "-", None)}
    two = reference.focus(pos, motif_hits(ref, [Motif("CG", 0), Motif("CGA", 0)]))
    assert two.where("ref_pos = 10").count() == 2 * one.where("ref_pos = 10").count()
    bases = reference.base_positions(ref, ["C"])
    assert rows(bases, "pos", "strand") == [(10, "+"), (11, "-")]
    assert rows(reference.base_positions(ref, ["C", "G"]), "pos", "strand", "base") == [(10, "+", "C"), (11, "+", "G")]
    bed = pileup.to_bedmethyl(pileup.pileup(pos, T)).withColumn("code", F.col("name"))
    assert {r["name"] for r in reference.at_reference_bases(bed, bases, pos="chromStart").collect()} == {"m", "h"}
    assert reference.shared_contigs(bed, ref).count() == 1
    with pytest.raises(ValueError):
        reference.shared_contigs(bed, ref.unionByName(ref.withColumn("chrom", F.lit("c9"))), "fail")
    assert reference.assign_codes(["x:C"])["x"] == "C"
    with pytest.raises(ValueError):
        reference.assign_codes(["x"])
    assert reference.read_motif(pos, Motif("CG", 0)).where("base = 'A'").count() == 0


def test_adjust(spark):
    pos = calls.positions(read_mods(spark, DATA)).where("read_id = 'a'")
    (r,) = calls.adjust(pos, convert=[("h", "m")]).collect()
    assert dict(r["probs"]) == {"m": 0.875} and r["codes"] == ["m"]
    (r,) = calls.adjust(pos, ignore=["h"]).collect()
    assert dict(r["probs"]) == {"m": 0.75 + 0.0625} and r["codes"] == ["m"]
    assert calls.adjust(pos, edge=(8, 0)).count() == 0 and calls.adjust(pos, edge=(7, 12)).count() == 1
    assert calls.adjust(pos, thresholds=P.Thresholds(0.9)).count() == 0


def test_depth_cap(spark):
    pos = calls.positions(read_mods(spark, DATA))
    assert calls.capped_depth(pos, 2).where("ref_pos = 10 and strand = '+'").count() == 2


@pytest.mark.parametrize("mixed", [False, True])
def test_bedmethyl_round_trip(spark, tmp_path, mixed):
    bed = pileup.to_bedmethyl(pileup.pileup(calls.positions(read_mods(spark, DATA)), T))
    at = str(tmp_path / "bed")
    writers.write_bedmethyl(bed, at, mixed=mixed)
    again = readers.bedmethyl(spark, at)
    assert rows(again.drop("code")) == rows(bed)
    assert readers.bedmethyl(spark, at, 2).count() == bed.where("valid_coverage >= 2").count()
    with pytest.raises(Exception, match="already exists"):
        writers.write_bedmethyl(bed, at)
    writers.write_bedmethyl(bed, at, force=True, compression="gzip")
    assert readers.bedmethyl(spark, at, known_codes_only=True).count() == bed.count()
    writers.write_bedgraph(bed, str(tmp_path / "graph"))
    writers.write_bedmethyl(bed, str(tmp_path / "h"), header=True)
    assert readers.bedmethyl(spark, str(tmp_path / "h")).count() == bed.count()
    writers.write_bedmethyl(bed.withColumn("key", F.lit("k")), str(tmp_path / "p"), partition="key")
    assert spark.read.text(str(tmp_path / "p")).count() == bed.count()
    writers.write_tsv(bed, str(tmp_path / "tsv"), compression="gzip")
    assert spark.read.csv(str(tmp_path / "tsv"), sep="\t", header=True).count() == bed.count()


def test_text_readers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    assert rows(readers.regions(spark, put("r.bed", "# x\nc1\t0\t10\nc1\t5\t9\tCpG: 4\nc2\t1\t3\tn\t0\t-\n\nc2\t5\t5\tempty\n")), "region_name", "strand") == [("CpG: 4", "."), ("c1:0-10", "."), ("n", "-")]
    assert rows(readers.regions(spark, put("b.bed", "c1 0 10 CpG: 47\n")), "region_name") == [("CpG: 47",)]
    assert rows(readers.position_filter(spark, put("p.bed", "c1\t0\t10\nc1\t5\t9\tx\nc2\t1\t3\tn\t0\t-\n")), "chrom", "strand") == [("c1", "."), ("c2", "-")]
    assert rows(readers.ground_truth(spark, put("t.bed", "c1\t0\t10\tm\t0\t+\nc1\t5\t9\t-\t0\t-\nc2\t1\t3\tzz\t0\t-\n")), "code") == [("-",), ("m",)]
    assert rows(readers.fasta(spark, put("f.fa", ">c1 first\nACgt\nNN\n>c2\nAC"))) == [("c1", "ACGTNN"), ("c2", "AC")]
    assert rows(readers.fasta(spark, put("f.fa", ">c1 first\nACgt\nNN\n"), mask=True)) == [("c1", "ACgtNN")]
    assert rows(readers.sizes(spark, put("s.fai", "c1\t100\t5\t60\t61\nc2\tx\n"))) == [("c1", 100)]
    assert [(c, m.raw, m.offset) for c, m in readers.known_motifs(spark, put("m.tsv", "mod_code\tmotif\toffset\nm\tCG\t0\n"))] == [("m", "CG", 0)]


def test_sam_round_trip(spark, tmp_path):
    text = "@HD\tVN:1.6\na\t0\tc1\t101\t60\t4M\t*\t0\t0\tACCG\tIIII\tMM:Z:C+m?,0;\tML:B:C,200\tMN:i:4\tRG:Z:x y\nb\t4\t*\t0\t0\t*\t*\t0\t0\tACCG\t*\nbroken\t1\n"
    (tmp_path / "x.sam").write_text(text)
    reads = readers.sam(spark, str(tmp_path / "x.sam"))
    got = {r["read_id"]: r for r in reads.collect()}
    a = got["a"]
    assert (a["pos"], a["mm"], a["ml"], a["mn"], a["tags"], a["qual"][:1], a["is_reverse"]) == (100, "C+m?,0;", [200], 4, {"RG": "x y"}, [40], False)
    assert set(got) == {"a", "b"} and got["b"]["chrom"] is None and got["b"]["mm"] is None
    writers.write_sam(reads, str(tmp_path / "out"))
    keep = ["read_id", "flag", "chrom", "pos", "seq", "mm", "ml", "mn"]
    assert rows(readers.sam(spark, str(tmp_path / "out")), *keep) == rows(reads, *keep)


SAM = [
    "a\t0\tc1\t101\t37\t4M\t=\t150\t53\tACCG\tIJ!~\tNM:i:1\tMM:Z:C+m?,0;\tML:B:C,200\tMN:i:4\tRG:Z:x y\tXB:B:f,1.5,2",
    "b\t4\t*\t0\t0\t*\t*\t0\t0\tACCG\t*",
    "c\t16\tc2\t7\t255\t2S2M\tc1\t9\t-4\tACCG\t!!!!\tMD:Z:4\tMD:Z:again",
]


def test_sam_is_written_as_it_was_read(spark, tmp_path):
    many = "\t".join(f"X{a}:i:{i}" for i, a in enumerate("abcdefghijklmnopqrstuvwxyz" * 60))
    data = [*SAM, f"d\t4\t*\t0\t0\t*\t*\t0\t0\tA\t*\t{many}"]
    (tmp_path / "x.sam").write_text("@HD\tVN:1.6\n" + "\n".join(data) + "\n")
    reads = readers.sam(spark, str(tmp_path / "x.sam"))
    assert readers.sam_header(spark, str(tmp_path / "x.sam")) == ["@HD\tVN:1.6"]
    writers.write_sam(reads, str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(data)
    none = reads.withColumn("mm", F.lit(None).cast("string")).withColumn("mn", F.lit(None).cast("int"))
    writers.write_sam(none, str(tmp_path / "none"))
    assert not spark.read.text(str(tmp_path / "none")).where("value rlike '\t(MM|ML|MN):'").count()


def test_adjusted_reads_keep_their_other_fields(spark, tmp_path):
    from strandline.operators import rewrite

    (tmp_path / "x.sam").write_text("\n".join(SAM) + "\na\t0\tc1\t101\t60\t4M\t*\t0\t0\tTCCG\tIIII\tMM:Z:C+mh?,0,0;\tML:B:C,10,240,200,20\tRG:Z:second\n")
    reads = readers.sam(spark, str(tmp_path / "x.sam"))
    writers.write_sam(rewrite.adjust_reads(reads, convert=[("h", "m")]), str(tmp_path / "out"))
    got = sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert got[0] == SAM[0] and got[2:] == SAM[1:]
    assert got[1].endswith("TCCG\tIIII\tMM:Z:C+m?,0,0;\tML:B:C,251,221\tRG:Z:second\tMN:i:4")
    called = {r["aux"][-1] if r["aux"] else "": (r["mm"], r["ml"]) for r in rewrite.call_reads(reads, P.Thresholds(0.7)).collect()}
    assert called["RG:Z:second"] == ("C+h?,0,0;C+m?,0,0;", [255, 0, 0, 255])


def test_regions(spark, tmp_path):
    from strandline.sources import layout

    sizes = {"c1": 500, "c2": 9}
    assert layout.parse_region("c1", sizes) == layout.Region("c1", 0, 500)
    assert layout.parse_region("x:1,000-2,500", sizes) == layout.Region("x", 1000, 2500)
    for bad in ("c3", "c1:5", "c1:5-5", "c1:9-5", "c1:1-2-3", "c1:1-2:3", "c1:-4", "c1:a-b", "c1:1-99999999999"):
        with pytest.raises(ValueError):
            layout.parse_region(bad, sizes)
    data = [(c, s, s + n, i) for i, (c, s, n) in enumerate((c, s, n) for c in ("c1", "c2", None) for s in range(0, 300, 7) for n in (1, 12, 95))]
    df = spark.createDataFrame(data, "chrom string, start long, end long, i int")
    layout.write(df, str(tmp_path / "t"), "start", "end", size=10)
    for r in (layout.Region("c1", 95, 96), layout.Region("c2", 0, 1), layout.Region("c1", 40, 77), layout.Region("c9", 0, 5)):
        got = layout.fetch(spark, str(tmp_path / "t"), [r], "start", "end", size=10)
        assert sorted(x["i"] for x in got.collect()) == [i for c, s, e, i in data if c == r.chrom and s < r.end and e > r.start]
    plan = layout.fetch(spark, str(tmp_path / "t"), [layout.Region("c1", 95, 96)], "start", "end", size=10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(_chrom" in plan.replace("isnotnull(_chrom#", "(_chrom").replace("PartitionFilters: [isnotnull", "PartitionFilters: [(_chrom") or "_bin" in plan.split("PartitionFilters")[1].split("]")[0]
    points = df.where("chrom is not null")
    layout.write(points, str(tmp_path / "p"), "start", size=10)
    assert layout.fetch(spark, str(tmp_path / "p"), [layout.Region("c1", 7, 15)], "start", size=10).count() == 6


def test_fasta_windows(spark, tmp_path):
    import random

    from strandline.operators import motifs

    rnd = random.Random(2)
    seqs = {f"c{k}": "".join(rnd.choice("ACGTacgtN") for _ in range(n)) for k, n in enumerate((1, 59, 60, 61, 333))}
    text, index = "", ""
    for c, s in seqs.items():
        text += f">{c} x\n"
        index += f"{c}\t{len(s)}\t{len(text)}\t60\t61\n"
        text += "".join(s[k : k + 60] + "\n" for k in range(0, len(s), 60))
    (tmp_path / "f.fa").write_text(text)
    (tmp_path / "f.fai").write_text(index)
    wins = readers.fasta_windows(spark, str(tmp_path / "f.fa"), str(tmp_path / "f.fai"), size=50, overlap=9)
    for r in wins.collect():
        a = r["start"] - r["before"]
        assert r["seq"] == seqs[r["chrom"]].upper()[a : a + len(r["seq"])] and r["core"] == min(50, len(seqs[r["chrom"]]) - r["start"])
    which = [Motif("CG", 0), Motif("DRACH", 2), Motif("GATC", 1), Motif("AN", 0)]
    whole = motifs.motif_hits(spark.createDataFrame(list(seqs.items()), "chrom string, seq string"), which)
    assert rows(motifs.motif_hits(wins, which)) == rows(whole) and whole.count() > 50


def test_hemi_table(spark):
    data = [("r", 0, "c", p, s, "C", code, q) for p in (10, 20) for s, code, q in (("+", "m", 0.9), ("-", "h", 0.95))]
    pos = spark.createDataFrame([(*d[:6], {d[6]: d[7]}, "call") for d in data], "read_id string, flag int, chrom string, ref_pos long, strand string, base string, probs map<string,double>, kind string")
    pos = pos.withColumn("ref_pos", F.when(F.col("strand") == "-", F.col("ref_pos") + 1).otherwise(F.col("ref_pos")))
    bed = writers.hemi_bedmethyl(pileup.pileup_hemi(pos, T))
    assert [(r["chromStart"], r["name"], r["strand"], r["score"], r["percent_modified"]) for r in bed.orderBy("chromStart").collect()] == [(10, "m,h,C", ".", 1, 100.0), (20, "m,h,C", ".", 1, 100.0)]


def test_md(spark):
    df = spark.createDataFrame([("10A5^AC6",), ("0T0",), ("",), (None,), ("3x",)], "md string")
    got = [r["p"] and [(x["kind"], x["n"], x["bases"]) for x in r["p"]] for r in df.select(tags.parse_md(F.col("md")).alias("p")).collect()]
    assert got == [[("match", 10, None), ("mismatch", 1, "A"), ("match", 5, None), ("deletion", 2, "AC"), ("match", 6, None)], [("match", 0, None), ("mismatch", 1, "T"), ("match", 0, None)], [], None, None]


def test_program_record(spark, tmp_path):
    once = writers.program_record(["@HD\tVN:1.6"], "strandline", "1", "x y")
    twice = writers.program_record(once, "strandline", "1", "z")
    assert once[-1] == "@PG\tID:strandline\tPN:strandline\tVN:1\tCL:x y"
    assert twice[-1] == "@PG\tID:strandline.1\tPN:strandline\tVN:1\tCL:z\tPP:strandline"
    (tmp_path / "x.sam").write_text("a\t0\tc1\t101\t60\t4M\t*\t0\t0\tACCG\tIIII\tMM:Z:C+m?,0;\tML:B:C,200\n")
    reads = readers.sam(spark, str(tmp_path / "x.sam"))
    writers.write_sam(reads, str(tmp_path / "out"), header=twice)
    assert readers.sam(spark, str(tmp_path / "out")).count() == 1
    assert spark.read.text(str(tmp_path / "out")).where("startswith(value, '@')").count() == 3


def test_stream_repair(spark, tmp_path):
    schema = "read_id string, flag int, chrom string, pos long, cigar string, seq string, mm string, ml array<int>, mn int"
    donors = spark.createDataFrame([("a", 0, None, None, None, "TTACCGCCGTACGG", "C+m?,0,1;", [200, 10], 14)], schema)
    part = spark.createDataFrame([("a", 0, None, None, None, "ACCGCCGT", None, None, None), ("x", 0, None, None, None, "AC", None, None, None)], schema)
    part.write.parquet(str(tmp_path / "in"))
    stream.run_to_end(stream.repaired(stream.read_rows(spark, str(tmp_path / "in")), donors), str(tmp_path / "out"), str(tmp_path / "state"))
    assert rows(spark.read.parquet(str(tmp_path / "out")), "read_id", "mm", "error") == [("a", "C+m?,0,1;", None), ("x", None, "no donor")]


def test_streams(spark, tmp_path):
    df = read_mods(spark, DATA).withColumn("loaded_at", F.expr("timestamp'2031-03-01 10:00:00' + make_interval(0, 0, 0, 0, 0, 0, ref_position)"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    source = stream.read_rows(spark, str(tmp_path / "in"), max_files=1)
    assert source.isStreaming
    stream.run_to_end(stream.pass_rows(source, T), str(tmp_path / "out"), str(tmp_path / "state"))
    assert rows(spark.read.parquet(str(tmp_path / "out")), "read_id", "passes") == rows(stream.pass_rows(df, T), "read_id", "passes")
    with pytest.raises(ValueError):
        stream.pass_rows(source, None)
    counts = stream.windowed_counts(source, T)
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from counts").first()[0] == len(DATA)
