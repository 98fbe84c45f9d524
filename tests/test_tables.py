import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import stats
from strandline.operators import dmr, entropy, intervals, tables, thresholds, validate
from tests.conftest import rows


def test_llr_matches_published_scores(spark):
    # fixed values: counts and scores of three regions
    data = [(57, 1777, 601, 2091, 257.34514203447543), (7, 1513, 14, 1349, 1.294227443419004), (43, 1228, 70, 1088, 5.013026381110649)]
    df = spark.createDataFrame(data, "ka long, na long, kb long, nb long, want double")
    for r in df.withColumn("got", stats.llr_beta(F.col("ka"), F.col("na"), F.col("kb"), F.col("nb"))).collect():
        assert r["got"] == pytest.approx(r["want"], abs=1e-8)


def test_ln_gamma():
    for x in (0.5, 1, 2.5, 7, 100, 12345.5, 1e8):
        assert stats.np_ln_gamma(np.array([x]))[0] == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12)


def test_llr_dispatch(spark):
    data = [({}, {}, 0.0), ({"m": 3}, {"h": 3}, None)]
    df = spark.createDataFrame(data, "a map<string,bigint>, b map<string,bigint>, want double")
    for r in df.withColumn("s", dmr.llr("a", "10L", "b", "10L")).collect():
        assert r["s"] == r["want"]
    # with two codes of which one is never met, Dirichlet and beta differ by no more than the third class explains
    two = spark.createDataFrame([({"m": 3, "h": 0}, {"m": 8, "h": 0})], "a map<string,bigint>, b map<string,bigint>")
    assert two.select(dmr.llr("a", "10L", "b", "10L")).first()[0] > 0


def beta_density_ratio(ka, na, kb, nb, d):
    """Density of the difference at 0 over that at d, by fine numeric integration."""
    u = (np.arange(200_000) + 0.5) / 200_000

    def at(shift):
        p, q = u, u - shift
        ok = (q > 0) & (q < 1)
        a1, b1, a2, b2 = 0.55 + ka, 0.55 + na - ka, 0.55 + kb, 0.55 + nb - kb
        f = np.exp((a1 - 1) * np.log(p[ok]) + (b1 - 1) * np.log1p(-p[ok]) + (a2 - 1) * np.log(q[ok]) + (b2 - 1) * np.log1p(-q[ok]))
        return f.sum()

    return at(0) / at(d)


def test_map_p_value():
    p, e = stats.map_p_value([5, 12, 2, 0], [10, 20, 20, 0], [5, 6, 14, 0], [10, 20, 20, 5], 100, 100)
    assert p[0] == 1 and e[0] == 0 and np.isnan(p[3])
    assert p[1] == pytest.approx(beta_density_ratio(12, 20, 6, 20, 0.3 - 0.005), rel=0.02)
    assert p[2] == pytest.approx(beta_density_ratio(2, 20, 14, 20, -0.6 + 0.005), rel=0.02)
    capped, _ = stats.map_p_value([100], [200], [20], [200], 20, 20)
    plain, _ = stats.map_p_value([10], [20], [2], [20], 20, 20)
    assert capped[0] == plain[0]


def plain_viterbi(seg, pos, score):
    gaps = np.diff(pos).astype(float)
    v = seg.start(score[0])
    path, _ = seg.path(np.r_[0, gaps], score, v, None)
    return path


def test_segments_do_not_depend_on_blocks(spark):
    rnd = np.random.default_rng(4)
    data = []
    for chrom, n in (("c1", 400), ("c2", 60), ("c3", 1)):
        pos = np.cumsum(rnd.integers(1, 60, n)) + (np.arange(n) > n // 2) * 10_000
        high = (np.arange(n) // 37) % 3 == 1
        score = np.where(high, rnd.normal(9, 2, n), rnd.normal(0.5, 1, n))
        data += [(chrom, int(p), float(s)) for p, s in zip(pos, score)]
    df = spark.createDataFrame([*data, ("c1", 10**7, None)], "chrom string, chromstart long, score double")
    got = [rows(dmr.Segmenter(block=b).segment(df), "chrom", "start", "end", "state", "num_sites") for b in (10**9, 1000, 97)]
    assert got[0] == got[1] == got[2]
    want = []
    seg = dmr.Segmenter()
    for chrom in ("c1", "c2", "c3"):
        own = sorted((p, s) for c, p, s in data if c == chrom)
        pos, score = np.array([p for p, _ in own]), np.array([s for _, s in own])
        cuts = [0, *(np.flatnonzero(np.diff(pos) >= 5000) + 1), len(pos)]
        for a, b in zip(cuts, cuts[1:]):
            path = plain_viterbi(seg, pos[a:b], score[a:b])[:-1]
            for state, run in itertools.groupby(zip(path, pos[a:b]), key=lambda x: x[0]):
                run = list(run)
                want.append((chrom, run[0][1], run[-1][1] + 1, ["same", "different"][state], len(run)))
    assert got[0] == sorted(want, key=repr)
    assert dmr.Segmenter().segment(df.limit(0)).count() == 0


def brute_path(seg, pos, score):
    best = None
    for states in itertools.product((0, 1), repeat=len(score)):
        v = seg.start(score[0])[states[0]]
        steps = seg.steps(np.diff(pos).astype(float), np.array(score[1:]))
        v += sum(steps[i][states[i], states[i + 1]] for i in range(len(steps)))
        if best is None or v > best[0]:
            best = (v, states)
    return list(best[1])


def test_viterbi_is_best():
    seg = dmr.Segmenter()
    rnd = np.random.default_rng(1)
    for _ in range(20):
        pos = np.cumsum(rnd.integers(1, 300, 8))
        score = rnd.normal(2, 4, 8)
        assert list(plain_viterbi(seg, pos, score)) == brute_path(seg, pos, list(score))


def bed(spark, data):
    return spark.createDataFrame(data, "chrom string, chromstart long, name string, strand string, valid_coverage long, count_modified long, count_canonical long, count_other_mod long, count_delete long, count_fail long, count_diff long, count_nocall long, n_mod string")


BED = [
    ("c", 10, "m", "+", 10, 4, 6, 0, 0, 0, 0, None, "x"),
    ("c", 10, "m", "+", 5, 5, 0, 0, 1, 1, 0, 1, "x"),
    ("c", 11, "m,CG,0", "-", 8, 2, 6, 0, 0, 0, 0, 0, "x"),
    (None, 11, "m", "-", 8, 2, 6, 0, 0, 0, 0, 0, "x"),
    ("d", 0, "h", ".", 3, 0, 3, 0, 0, 0, 0, 0, "x"),
]


def test_merge_with_itself_doubles(spark):
    b = bed(spark, BED)
    once, twice = tables.merge(b), tables.merge(b.unionByName(b))
    key = ["chrom", "chromstart", "name", "strand", "percent_modified"]
    assert rows(once, *key) == rows(twice, *key)
    assert rows(once.select(F.col("count_modified") * 2, F.col("valid_coverage") * 2)) == rows(twice, "count_modified", "valid_coverage")
    assert tables.merge(b.limit(0)).count() == 0


def test_points_in_against_brute_force(spark):
    rnd = random.Random(2)
    pts = [(rnd.choice("ab"), rnd.randrange(0, 5000), rnd.choice("+-.")) for _ in range(300)] + [(None, 5, "+"), ("a", None, "+")]
    ivs = [(rnd.choice("ab"), s := rnd.randrange(0, 5000), s + rnd.choice([0, 1, 30, 1500]), rnd.choice("+-."), i) for i in range(60)]
    p = spark.createDataFrame(pts, "chrom string, pos long, strand string")
    r = spark.createDataFrame(ivs, "chrom string, start long, end long, strand string, i int")

    def hit(x, y):
        return x[0] == y[0] and x[0] and x[1] is not None and y[1] <= x[1] < y[2] and (x[2] == "." or y[3] == "." or x[2] == y[3])

    for size in (100, 100_000):
        inner = intervals.points_in(p, r, "pos", "inner", "strand", size)
        assert rows(inner, "chrom", "pos", "i") == sorted([(x[0], x[1], y[4]) for x in pts for y in ivs if hit(x, y)], key=repr)
        semi = intervals.points_in(p, r, "pos", "semi", "strand", size)
        assert rows(semi, "chrom", "pos", "strand") == sorted([x for x in pts if any(hit(x, y) for y in ivs)], key=repr)
        anti = intervals.points_in(p, r, "pos", "anti", "strand", size)
        assert rows(anti, "chrom", "pos", "strand") == sorted([x for x in pts if not any(hit(x, y) for y in ivs)], key=repr)


def test_containing_and_merging(spark):
    reads = spark.createDataFrame([("r1", "c", 0, 500), ("r2", "c", 100, 130)], "read_id string, chrom string, ref_start long, ref_end long")
    wins = spark.createDataFrame([("c", 100, 130), ("c", 0, 600), ("c", 499, 501)], "chrom string, start long, end long")
    assert rows(intervals.containing(reads, wins, 64), "read_id", "start") == [("r1", 100), ("r2", 100)]
    iv = spark.createDataFrame([("c", 5, 9), ("c", 0, 5), ("c", 20, 30), ("c", 22, 25), (None, 1, 2)], "chrom string, start long, end long")
    rnd = random.Random(8)
    many = [("c", s := rnd.randrange(3000), s + rnd.choice([1, 5, 5, 40])) for _ in range(300)] * 2
    df = spark.createDataFrame(many, "chrom string, start long, end long")
    want = []
    for c, s, e in sorted(many):
        if want and s <= want[-1][2]:
            want[-1] = (c, want[-1][1], max(e, want[-1][2]), want[-1][3] + 1)
        else:
            want.append((c, s, e, 1))
    for size in (7, 100, 10**6):
        assert rows(intervals.merge(df, size=size), "chrom", "start", "end", "n") == sorted(want, key=repr)
    assert rows(intervals.merge(iv), "chrom", "start", "end", "n") == [("c", 0, 9, 2), ("c", 20, 30, 2)]


def test_track_prefers_coverage(spark):
    data = [("c", 5, "m", "+", 10, 4, 6, 0, 0, 0, 0, 0, ""), ("c", 5, "h", "+", 10, 1, 9, 0, 0, 0, 0, 0, ""), ("c", 5, "m", "-", 12, 6, 6, 0, 0, 0, 0, 0, ""), ("c", 6, "m", "+", 4, 1, 3, 0, 0, 0, 0, 0, ""), ("c", 6, "m", "-", 4, 3, 1, 0, 0, 0, 0, 0, "")]
    assert rows(tables.track(bed(spark, data), ["m", "h"]), "start", "value") == [(5, -50.0), (6, 25.0)]


def brute_entropy(patterns):
    n = len(next(iter(patterns)))
    cols = [sorted({p[i] for p in patterns if p[i] != "*"}) for i in range(n)]
    full = [("".join(x)) for x in itertools.product(*cols)]
    fits = lambda p, f: all(a == "*" or a == b for a, b in zip(p, f))
    # a full pattern counts if some observed pattern allows each step to it
    full = [f for f in full if all(any(fits(p[: i + 1], f[: i + 1]) for p in patterns) for i in range(1, n))]
    count = dict.fromkeys(full, 0.0)
    for p, c in patterns.items():
        own = [f for f in full if fits(p, f)]
        for f in own:
            count[f] += c / len(own)
    whole = sum(count.values())
    return -sum(c / whole * math.log2(c / whole) for c in count.values() if c) / n


def test_entropy():
    assert entropy.entropy({"0000": 5}) == 0
    assert entropy.entropy({"0000": 2, "1111": 2}) == pytest.approx(0.25)
    assert entropy.entropy({f"{i:04b}": 1 for i in range(16)}) == pytest.approx(1.0)
    rnd = random.Random(6)
    for _ in range(100):
        pats = {"".join(rnd.choice("01*" if i else "01") for i in range(4)): rnd.randrange(1, 4) for _ in range(rnd.randrange(1, 6))}
        if all(any(p[i] != "*" for p in pats) for i in range(4)):
            assert entropy.entropy(pats) == pytest.approx(brute_entropy(pats))


def test_windows(spark):
    pos = [5, 10, 14, 30, 49, 60, 61, 2000]
    df = spark.createDataFrame([("c", "+", p) for p in pos] + [(None, "+", 3)], "chrom string, strand string, pos long")
    for size in (64, 1000):
        got = rows(entropy.windows(df, 3, 50, 2, size).where("k = 0"), "start", "end")
        want = [(pos[i], pos[i + 2] + 2) for i in range(len(pos) - 2) if pos[i + 2] + 2 - pos[i] <= 50]
        assert got == sorted(want, key=repr)


def test_accuracy(spark):
    data = [("m", "m", 0.9)] * 30 + [("m", "-", 0.6)] * 10 + [("-", "-", 0.8)] * 15 + [("-", "m", 0.55)] * 5 + [("m", "no_call", None)] * 3
    df = spark.createDataFrame(data, "truth string, call string, p double")
    balanced = validate.balance(df)
    assert {r["truth"]: r["n"] for r in balanced.groupBy("truth").agg(F.sum("c").alias("n")).collect()} == {"m": 20, "-": 20}
    r = validate.accuracy(balanced).first()
    assert r["n"] == 40 and r["raw_accuracy"] == pytest.approx(75.0) and r["filtered_accuracy"] >= r["raw_accuracy"]


def test_quotas(spark):
    reads = spark.createDataFrame([(f"r{i}", 0, "a" if i % 4 else "b", i * 10) for i in range(400)] + [("x", 4, None, None)], "read_id string, flag int, chrom string, ref_start long")
    assert rows(thresholds.contig_quotas(reads, 100), "chrom", "quota") == [("a", 75), ("b", 25)]
    got = thresholds.sample_even(reads, 100, bins=5)
    assert {r["chrom"]: r["n"] for r in got.groupBy("chrom").agg(F.count("*").alias("n")).collect()} == {"a": 75, "b": 25}
    assert rows(got) == rows(thresholds.sample_even(reads.repartition(7), 100, bins=5))


def test_fraction(spark):
    reads = spark.createDataFrame([(f"r{i}",) for i in range(2000)] + [(None,)], "read_id string")
    some = thresholds.sample_fraction(reads, 0.2)
    assert rows(some) == rows(thresholds.sample_fraction(reads.repartition(5), 0.2)) and 330 < some.count() < 470
    assert set(rows(some)) <= set(rows(thresholds.sample_fraction(reads, 0.5))) and thresholds.first_reads(reads, 7).count() == 7
    with pytest.raises(ValueError):
        thresholds.sample_fraction(reads, 2)


def test_pool_balanced(spark):
    data = [("s1", "c", 1, "+", {"m": 5}, 10), ("s2", "c", 1, "+", {"m": 30, "h": 2}, 40), ("s1", "c", 2, "+", {"m": 3}, 7)]
    df = spark.createDataFrame(data, "sample_id string, chrom string, chromstart long, strand string, counts map<string,bigint>, total long")
    got = {r["chromstart"]: (dict(r["counts"]), r["total"]) for r in dmr.pool(df, ["chrom", "chromstart", "strand"], balanced=True).collect()}
    assert got == {1: ({"m": 12 + 18, "h": 1}, 50), 2: ({"m": 3}, 7)}
    plain = {r["chromstart"]: (dict(r["counts"]), r["total"]) for r in dmr.pool(df, ["chrom", "chromstart", "strand"]).collect()}
    assert plain == {1: ({"m": 35, "h": 2}, 50), 2: ({"m": 3}, 7)}


def test_quotas_are_pruned(spark):
    """Small contigs go, the smallest first and by name, until the sum is near the target."""
    n = {"big": 900, **{f"c{i:02d}": 1 + i % 3 for i in range(30)}}
    reads = spark.createDataFrame([(c,) for c, k in n.items() for _ in range(k)], "chrom string")
    target, whole = 10, sum(n.values())
    want = {c: min(k, math.ceil(k * target / whole - 1e-9)) for c, k in n.items()}
    total = sum(want.values())
    floor = 1
    while total > 1.5 * target:
        for c in sorted(want, key=lambda c: (want[c], c)):
            if total <= target:
                break
            if 0 < want[c] <= floor:
                total -= want[c]
                want[c] = 0
        floor += 1
    assert {r["chrom"]: r["quota"] for r in thresholds.contig_quotas(reads, target).collect()} == want
    assert sum(want.values()) <= 1.5 * target and want["big"]


def test_percentiles_by_bins(spark):
    rnd = random.Random(4)
    data = [(b, {"m": rnd.choice([rnd.random(), 0.5, 0.25, 1.0])}, "call") for b in "CCCCA" for _ in range(400)] + [("T", {"g": 0.5}, "call")]
    pos = spark.createDataFrame(data, "base string, probs map<string,double>, kind string")
    got = {(r["base"], r["q"]): r["value"] for r in thresholds.base_percentiles(pos, [0.0, 0.1, 0.5, 0.77, 1.0]).collect()}
    for b in "CA":
        own = sorted(max(p["m"], 1 - p["m"]) for x, p, _ in data if x == b)
        for q in (0.0, 0.1, 0.5, 0.77, 1.0):
            spot = (len(own) - 1) * q
            lo, hi = own[math.floor(spot)], own[math.ceil(spot)]
            assert got[b, q] == pytest.approx(lo + (hi - lo) * (spot - math.floor(spot)), abs=1e-12)
    assert len(got) == 10


def test_tables_made_are_deleted(spark, tmp_path):
    import os

    from strandline import session

    a, b = session.materialize(spark.range(5)), session.materialize(spark.range(7))
    paths = [x._strandline_path.removeprefix("file://") for x in (a, b)]
    assert all(map(os.path.isdir, paths))
    session.release(a)
    assert not os.path.isdir(paths[0]) and b.count() == 7
    session.release_all()
    assert not os.path.isdir(paths[1]) and not session._made
