import itertools
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from strandline.functions import seq as S
from strandline.functions import tags
from strandline.operators import motifs
from tests.conftest import rows


def test_skips_and_positions_are_inverse():
    seq = "ACCGTCACCN"
    assert tags.positions_of(seq, "C", [1, 0, 1]) == [2, 5, 8]
    assert tags.skips_of(seq, "C", [2, 5, 8]) == [1, 0, 1]
    assert tags.positions_of(seq, "N", [3, 0]) == [3, 4]
    rnd = random.Random(3)
    for _ in range(200):
        s = "".join(rnd.choice("ACGT") for _ in range(60))
        at = [i for i, c in enumerate(s) if c == "G" and rnd.random() < 0.4]
        assert tags.positions_of(s, "G", tags.skips_of(s, "G", at)) == at


@pytest.mark.parametrize(
    "mm,ml,error",
    [
        ("C+m?,9;", [1], "skips beyond the end of the read"),
        ("C+m?,0;", [], "too few qualities"),
        ("C+m?,0;", [1, 2], "too many qualities"),
        ("C*m,0;", [1], "malformed tag"),
        ("C+m?,0;C+h?,0;", [200, 200], "probabilities add up to more than 1"),
    ],
)
def test_errors(mm, ml, error):
    with pytest.raises(tags.TagError) as e:
        tags.decode("ACCG", mm, ml)
    assert e.value.code == error


def test_length_tag():
    with pytest.raises(tags.TagError):
        tags.decode("ACCG", "C+m?,0;", [1], 5)
    with pytest.raises(tags.TagError):
        tags.decode("ACCG", "C+m?,0;", [1], None, primary=False)


def test_modes_and_blocks():
    out = tags.decode("ACCG", "C+mh.,1;", [10, 20])
    assert out["+", "C", 2] == ({"m": 10.5 / 256, "h": 20.5 / 256}, False, False)
    assert out["+", "C", 1] == ({"m": 0.0, "h": 0.0}, True, False)
    assert set(tags.decode("ACCG", "C+m?,1;", [10])) == {("+", "C", 2)}
    two = tags.decode("ACCG", "C+m?,0;C+h?,0;", [100, 50])
    assert two["+", "C", 1][0] == {"m": 100.5 / 256, "h": 50.5 / 256}
    chebi = tags.decode("ACCG", "C+21839?,0;", [7])
    assert chebi["+", "C", 1][0] == {"21839": 7.5 / 256}


def test_encode_decode_round_trip():
    rnd = random.Random(5)
    for _ in range(50):
        s = "".join(rnd.choice("ACGT") for _ in range(80))
        calls = {("+", c, i): {"m" if c == "C" else "a": (rnd.randrange(256) + 0.5) / 256} for i, c in enumerate(s) if c in "CA" and rnd.random() < 0.3}
        mm, ml = tags.encode(s, calls)
        assert {k: v[0] for k, v in tags.decode(s, mm, ml).items()} == calls


def test_reads(spark):
    data = [
        ("a", 0, "chr1", 100, "2S4M2D4M", "ACCGCCGTAC", "C+m?,0,1;", [200, 10], 10),
        ("b", 16, "chr1", 100, "10M", "ACCGCCGTAC", "C+m?,0;", [200], None),
        ("c", 4, None, None, None, "ACCG", "C+m?,0;", [200], 4),
        ("d", 0, "chr1", 1, "4M", "ACCG", None, None, None),
        ("e", 0, "chr1", 1, "4M", "ACCG", "C+m?,7;", [1], 4),
        ("f", 0, "chr1", 1, "*", None, "C+m?,0;", [1], None),
    ]
    df = spark.createDataFrame(data, "read_id string, flag int, chrom string, pos long, cigar string, seq string, mm string, ml array<int>, mn int")
    got = rows(tags.decode_reads(df), "read_id", "fwd_pos", "ref_pos", "aln_strand")
    # read a: positions 1 (soft clip) and 4; read b: its own direction is GTACGGCGGT, first C at 3
    assert got == [("a", 1, -1, "+"), ("a", 4, 102, "+"), ("b", 3, 106, "-"), ("c", 1, -1, ".")]
    pos = tags.to_positions(tags.decode_reads(df))
    assert {r["strand"] for r in pos.where("read_id = 'b'").collect()} == {"-"} or {r["strand"] for r in pos.where("read_id = 'b'").collect()} == {"-", "+"}
    seen = Observation()
    tags.tracked(tags.check_tags(df), seen).collect()
    assert seen.get == {"used": 3, "skipped": 2, "failed": 1}
    census = {(r["kind"], r["name"]): r["n"] for r in tags.census(tags.check_tags(df)).collect()}
    assert census[("header", "C+m?")] == 3 and census[("error", "no tags")] == 1 and census[("error", "skips beyond the end of the read")] == 1 and census[("error", "no sequence")] == 1


def test_reads_round_trip_by_rewriting(spark):
    data = [("a", 0, "chr1", 100, "10M", "ACCGCCGTAC", "C+m?,0,1;", [200, 10], 10), ("b", 16, "chr1", 100, "10M", "ACCGCCGTAC", "C+m?,0;", [200], 10)]
    df = spark.createDataFrame(data, "read_id string, flag int, chrom string, pos long, cigar string, seq string, mm string, ml array<int>, mn int")
    again = tags.encode_reads(df, tags.decode_reads(df))
    assert rows(again, "read_id", "mm", "ml", "mn") == rows(df, "read_id", "mm", "ml", "mn")
    assert [r["x"] for r in df.select(tags.update_mode(F.col("mm"), ".").alias("x")).orderBy("read_id").collect()] == ["C+m.,0,1;", "C+m.,0;"]


def test_repair(spark):
    schema = "read_id string, flag int, chrom string, pos long, cigar string, seq string, mm string, ml array<int>, mn int"
    donor = spark.createDataFrame([("a", 0, None, None, None, "TTACCGCCGTACGG", "C+m?,0,1;", [200, 10], 14), ("r", 0, None, None, None, "ACAC", "C+m?,0;", [9], 4)], schema)
    part = spark.createDataFrame([("a", 0, None, None, None, "ACCGCCGT", None, None, None), ("r", 0, None, None, None, "AC", None, None, None), ("x", 0, None, None, None, "AC", None, None, None), ("a", 0, None, None, None, "GGGGG", None, None, None)], schema)
    got = rows(tags.repair(donor, part), "read_id", "seq", "mm", "ml", "error")
    assert got == sorted([("a", "ACCGCCGT", "C+m?,0,1;", [200, 10], None), ("a", "GGGGG", None, None, "not in the donor"), ("r", "AC", None, None, "more than once in the donor"), ("x", "AC", None, None, "no donor")], key=repr)


def test_motif_hits(spark):
    df = spark.createDataFrame([("x", "ACGTCGA"), ("y", None), ("z", "")], "chrom string, seq string")
    hits = motifs.motif_hits(df, [S.Motif("CG", 0)])
    assert rows(hits, "chrom", "pos", "strand") == [("x", 1, "+"), ("x", 2, "-"), ("x", 4, "+"), ("x", 5, "-")]
    assert S.Motif("CG", 0).palindrome and S.Motif("CG", 0).partner(4) == 5 and S.Motif("CHH", 0).partner(4) is None
    seq = "GGACTAACATGTCC"
    want = sorted([(i + 2, "+") for i in range(10) if _like(seq[i : i + 5], "DRACH")] + [(i + 2, "-") for i in range(10) if _like(S.reverse_complement(seq[i : i + 5]), "DRACH")])
    assert S.Motif("DRACH", 2).hits(seq) == want
    with pytest.raises(ValueError):
        S.Motif("CG", 2)


def _like(kmer, motif):
    return len(kmer) == len(motif) and all(b in S.IUPAC[m] for b, m in zip(kmer, motif))


def test_sequences(spark):
    assert S.reverse_complement("ACGTN") == "NACGT"
    df = spark.createDataFrame([("[AC]GT", "ACGTA")], "p string, s string")
    r = df.select(S.reverse_complement_column(F.col("p")).alias("p"), S.kmer(F.col("s"), F.lit(0), 5).alias("a"), S.kmer(F.col("s"), F.lit(2), 4).alias("b"), S.kmer(F.col("s"), F.lit(9), 5).alias("c")).first()
    assert tuple(r) == ("AC[GT]", "--ACG", "CGTA", None)
    c = spark.createDataFrame([("5S10M2I3D4M6S", 3)], "cigar string, nm int")
    start, end = S.soft_clips(F.col("cigar"), F.lit(True))
    got = c.select(start, end, S.identity_q(F.col("nm"), F.col("cigar")), S.identity_q(F.col("nm"), F.col("cigar"), 100)).first()
    assert (got[0], got[1]) == (6, 5) and got[2] == pytest.approx(8.016, abs=1e-2) and got[3] is None


def planted(n=20000, seed=1):
    """K-mers of nine bases around an A; those that show GATC are highly modified."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        k = "".join(rnd.choice("ACGT") for _ in range(9))
        k = k[:4] + "A" + k[5:]
        hit = k[3:7] == "GATC"
        out.append(("high" if hit and rnd.random() < 0.97 else "low", k, "a", 1))
    return out


def test_search_finds_a_planted_motif(spark):
    kmers = spark.createDataFrame(planted(), "level string, kmer string, code string, n int")
    s = motifs.Search(kmers, focus=4, length=9, base="A", min_sites=100, min_frac=0.8)
    found = s.table(s.run((1, 1), seed_size=2))
    assert [(m, o) for m, o, *_ in found] == [("GATC", 1)]
    assert motifs.text_of(s.refine(motifs.masks_of("GAT", 1)), "A") == ("GATC", 1)


def test_evaluate_against_brute_force(spark):
    data = planted(2000)
    kmers = spark.createDataFrame(data, "level string, kmer string, code string, n int")
    got = {r["motif"]: (r["high"], r["low"]) for r in motifs.evaluate(kmers, [("GATC", 1, "a"), ("RAY", 1, "a"), ("AAAAAAA", 0, "a")], 4).collect()}
    for motif, offset in (("GATC", 1), ("RAY", 1), ("AAAAAAA", 0)):
        want = [sum(1 for lv, k, *_ in data if lv == level and _like(k[4 - offset : 4 - offset + len(motif)], motif)) for level in ("high", "low")]
        assert got[motif] == tuple(want)


def test_relations_and_merging():
    m = motifs.masks_of
    assert motifs.relation(m("CG", 0), m("CG", 0)) == "equal"
    assert motifs.relation(m("CGA", 0), m("CG", 0)) == "superset"
    assert motifs.relation(m("CG", 0), m("CGA", 0)) == "subset"
    assert motifs.relation(m("CG", 0), m("CT", 0)) == "disjoint"
    assert motifs.merge([m("CG", 0), m("CGA", 0), m("CT", 0)]) == [m("CGA", 0), m("CT", 0)]
    for letter, mask in itertools.product(S.IUPAC, [0]):
        assert S.MASK[letter] > mask
    assert motifs.cluster(["AA", "AC", "GT"]) == [[1, 3], [4, 8]]


def test_modified_bases(spark):
    data = [("C+hm?,0;A+a,1;",), ("C+m?;",), ("T-17802.,4;U+g;",), ("broken",), (None,), ("C+m?,1;C+m?,2;",)]
    got = {tuple(r)[:4]: r["n"] for r in tags.modified_bases(spark.createDataFrame(data, "mm string")).collect()}
    assert got == {("+", "C", "h", "?"): 1, ("+", "C", "m", "?"): 3, ("+", "A", "a", "."): 1, ("-", "T", "17802", "."): 1, ("+", "T", "g", "."): 1}


def test_deletions_and_uncalled(spark):
    from strandline.operators import calls, validate

    schema = "read_id string, flag int, chrom string, pos long, cigar string, seq string"
    reads = spark.createDataFrame([("a", 0, "c", 10, "2S2M2D1I3M", "TTCCACGT"), ("b", 16, "c", 10, "5M", "GGAGA"), ("u", 4, None, None, None, "CC"), ("e", 0, "c", 12, "*", "C")], schema)
    assert rows(calls.deletions(reads), "read_id", "ref_pos") == [("a", 12), ("a", 13)]
    own = spark.createDataFrame([("a", 0, "c", 10, "+"), ("b", 16, "c", 11, "-")], "read_id string, flag int, chrom string, ref_pos long, strand string")
    truth = spark.createDataFrame([("c", p, s, "m") for p in range(8, 19) for s in "+-"], "chrom string, pos long, strand string, code string")
    got = rows(validate.uncalled(reads, own, truth), "read_id", "status")
    assert got == sorted([("a", "no_call"), ("a", "deletion"), ("a", "deletion"), ("a", "no_call"), ("a", "mismatch G"), ("a", "mismatch T"), ("b", "no_call"), ("b", "mismatch T"), ("b", "no_call"), ("b", "mismatch T")], key=repr)
