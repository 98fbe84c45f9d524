import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from strandline.llm import sample, select
from tests.conftest import rows

DAY = datetime.date(2031, 3, 1)


def calls(spark, n=6000, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        code = rnd.choice(["-"] * 6 + ["m", "m", "h", None])
        p = rnd.choice([None, float("nan"), -1.0, 255.0, float("inf")]) if rnd.random() < 0.05 else rnd.random() if rnd.random() < 0.6 else rnd.choice([0.5, 0.9, 1.0])
        out.append((code, p, DAY + datetime.timedelta(days=rnd.randrange(4)), i, "x"))
    out += out[:50]
    return spark.createDataFrame(out, "call_code string, call_prob double, batch_day date, c int, v string"), out


def good(p):
    return p is not None and 0 <= p <= 1


@pytest.mark.parametrize("depth", [1, 5])
def test_percentiles_are_exact(spark, depth, monkeypatch):
    monkeypatch.setattr(select.multiselect, "__defaults__", (depth,))
    df, data = calls(spark)
    qs = [0.0, 0.1, 0.5, 0.999, 1.0]
    got = {(r["call_code"], r["q"]): (r["n"], r["rank"], r["value"]) for r in select.percentiles(df.repartition(5), ["call_code"], "call_prob", qs, low=0, high=1).collect()}
    for code in {d[0] for d in data}:
        own = sorted(d[1] for d in data if d[0] == code and good(d[1]))
        for q in qs:
            rank = max(1, math.ceil(q * len(own) - 1e-9))
            assert got[code, q] == (len(own), rank, own[rank - 1])
    assert len(got) == len({d[0] for d in data}) * len(qs)


def test_combined_summaries_keep_their_bound(spark):
    df, data = calls(spark)
    s = select.summaries(df, ["call_code", "batch_day"], "call_prob", 16, 0, 1)
    for r in select.combine(s, ["call_code"], [0.1, 0.5, 0.9], ["batch_day"]).collect():
        own = sorted(d[1] for d in data if d[0] == r["call_code"] and good(d[1]))
        assert r["n"] == len(own)
        lo, hi = sum(x < r["value"] for x in own) + 1, sum(x <= r["value"] for x in own)
        off = 0 if lo <= r["rank"] <= hi else min(abs(lo - r["rank"]), abs(hi - r["rank"]))
        assert off <= r["rank_error"] <= len(own) / 16 + 4 * 2


def test_empty_and_unusable(spark):
    df, _ = calls(spark, 10)
    assert select.percentiles(df.limit(0), ["call_code"], "call_prob", [0.5]).count() == 0
    assert select.percentiles(df.withColumn("call_prob", F.lit(None).cast("double")), ["call_code"], "call_prob", [0.5]).count() == 0
    s = select.summaries(df.limit(0), ["call_code", "batch_day"], "call_prob")
    assert select.combine(s, ["call_code"], [0.5], ["batch_day"]).count() == 0


def test_slices_of_groups(spark):
    """Groups beyond the number handled at a time give the same."""
    df, _ = calls(spark, 3000)
    levels = {"code": ["call_code"], "both": ["call_code", "batch_day"]}
    args = (df, ["call_code", "batch_day"], "call_prob", [0.25, 0.5], levels)
    order = ("level", "call_code", "batch_day", "q", "n", "value")
    want = rows(select.percentiles(*args), *order)
    assert len(want) == 2 * (4 + 16)
    assert rows(select.percentiles(*args, at_once=7), *order) == want
    s = rows(select.summaries(df, ["call_code"], "call_prob", 8), "call_code", "rank", "value", "weight")
    assert rows(select.summaries(df, ["call_code"], "call_prob", 8, at_once=1), "call_code", "rank", "value", "weight") == s


def test_multiselect_against_sorting(spark):
    import pandas as pd

    rnd = random.Random(9)
    data = [(f"g{rnd.randrange(4)}", float(rnd.choice([rnd.randrange(5), rnd.gauss(0, 1e6), -0.25]))) for _ in range(4000)]
    counts = spark.createDataFrame(data, "k string, v double").groupBy("k", "v").agg(F.count("*").alias("c")).repartition(6)
    own = {k: sorted(v for g, v in data if g == k) for k in {g for g, _ in data}}
    wanted = pd.DataFrame([(k, r) for k, v in own.items() for r in {1, len(v), *rnd.sample(range(1, len(v) + 1), 25)}], columns=["k", "rank"])
    for depth in (1, 2, 5):
        got = select.multiselect(counts, ["k"], wanted, depth)
        assert len(got) == len(wanted)
        for k, rank, value, below, equal in got.itertuples(index=False):
            assert value == own[k][rank - 1] and below == sum(x < value for x in own[k]) and equal == own[k].count(value)
    with pytest.raises(ValueError):
        select.multiselect(counts, ["k"], pd.DataFrame({"k": ["none"], "rank": [1]}))


def best_cutoff(values, f):
    goal = f * len(values)
    options = [(abs(sum(v >= c for v in values) - goal), -sum(v >= c for v in values), c) for c in set(values)] + [(goal, 0, None)]
    d, n, c = min(options, key=lambda o: o[:2])
    return c, -n


def test_cutoffs_against_brute_force(spark):
    rnd = random.Random(3)
    data = [(rnd.choice("CA"), rnd.choice("mha"), rnd.choice([None, float("nan"), 7.0]) if rnd.random() < 0.1 else rnd.randrange(300) / 300 if rnd.random() < 0.7 else 0.5, "k", 1) for _ in range(5000)] + [(None, "m", 0.5, "k", 1), ("C", None, 0.5, "k", 1)]
    df = spark.createDataFrame(data, "base string, code string, q double, k string, n int")
    targets = [("C", "m", 0.9), ("C", "h", 0.0), ("A", "a", 1.0), ("A", "m", 0.37), ("T", "g", 0.5), ("A", "h", 0.001), (None, "m", 0.5), ("C", "a", None)]
    t = spark.createDataFrame(targets, "base string, code string, keep_fraction double")
    got = {(r["base"], r["code"]): r for r in select.cutoffs(df, t, ["base", "code"], "q", low=0, high=1).collect()}
    assert len(got) == len(targets)
    for base, code, f in targets:
        own = [d[2] for d in data if d[:2] == (base, code) and good(d[2])] if base else []
        r = got[base, code]
        assert r["n"] == len(own) and r["n_kept"] + r["n_dropped"] == len(own)
        if own and f is not None:
            assert (r["cutoff"], r["n_kept"]) == best_cutoff(own, f)
            assert r["n_unusable"] == sum(d[:2] == (base, code) and not good(d[2]) for d in data)
        else:
            assert r["cutoff"] is None
    assert select.cutoffs(df.limit(0), t, ["base", "code"], "q").where("n > 0").count() == 0


IDS = [f"Read-{i:05d}" for i in range(4000)]


def reads(spark, ids, day=DAY):
    return spark.createDataFrame([(i, day, "x", "y") for i in ids], "read_id string, batch_day date, sample_key string, unit string")


def test_sample_is_stable(spark):
    old, new = IDS[:2000], IDS
    one = {r["sample_key"] for r in sample.sample_rows(reads(spark, old), "read_id", 0.1).collect()}
    two = {r["sample_key"] for r in sample.sample_rows(reads(spark, new).repartition(9), "read_id", 0.1).collect()}
    assert one <= two and one == {k for k in two if k < "read-02000"}
    assert one <= {r["sample_key"] for r in sample.sample_rows(reads(spark, old), "read_id", 0.2).collect()}
    assert 150 < len(one) < 250
    other = {r["sample_key"] for r in sample.sample_rows(reads(spark, [f"  {x.upper()} " for x in old]), "read_id", 0.1).collect()}
    assert other == one


def test_sample_edges(spark):
    df = reads(spark, [None, "", "  ", "a", "a"])
    assert sample.sample_rows(df, "read_id", 1.0).count() == 2 and sample.sample_rows(df, "read_id", 0.0).count() == 0
    assert sample.sample_rows(df.limit(0), "read_id", 0.5).count() == 0
    with pytest.raises(ValueError):
        sample.selected(F.lit("a"), 1.5)
    unit = reads(spark, IDS).select(sample.unit(F.lower("read_id")).alias("u"), sample.selected(F.lower("read_id"), 0.25).alias("s"))
    assert unit.where("(u < 0.25) <> s or u < 0 or u >= 1").count() == 0


def test_both_tables_agree(spark):
    a, b = reads(spark, IDS[:1000]), reads(spark, [x.upper() for x in IDS[500:1500]], DAY + datetime.timedelta(days=1))
    got = sample.sample_reads({"a": a, "b": b}, "read_id", 0.3, "batch_day").collect()
    assert all(r["n_a"] == (r["sample_key"] < "read-01000") and r["n_b"] == (r["sample_key"] >= "read-00500") for r in got)
    g = sample.growth({"a": a, "b": b}, "read_id", 0.3, "batch_day").orderBy("day").collect()
    assert g[-1]["selected"] == len(got) and g[0]["selected"] <= g[1]["selected"] and g[1]["keys"] == 1500
