import random
from collections import defaultdict

import pytest

from strandline.llm import mixing
from tests.conftest import rows


def test_quotas():
    have = {"a": 1000, "b": 1000, "c": 10}
    q = mixing.quotas(have, {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 3), "none": (0.1, 2)}, 1500)
    assert q["c"] == 30 and sum(q.values()) in (1499, 1500) and q["a"] <= 1000
    assert q["a"] / q["b"] == pytest.approx(5 / 3, rel=0.01)
    assert mixing.quotas({}, {"a": (0.5, 1)}, 100) == {}
    assert mixing.quotas(have, {"a": (1.0, 1)}, 10**6) == {"a": 1000}
    assert mixing.quotas(have, {"a": (None, None), "b": (0.0, 3)}, 100) == {}


@pytest.mark.parametrize("seed", range(5))
def test_schedule_deviates_by_less_than_a_block(seed):
    rnd = random.Random(seed)
    quota = {f"s{i}": rnd.randrange(1, 10_000) for i in range(6)}
    block, plan = mixing.schedule(quota, 500)
    whole, done = sum(quota.values()), defaultdict(int)
    assert [p[0] for p in plan] == list(range(len(plan)))
    for slot, s, i in plan:
        assert i == done[s]
        done[s] += 1
        if slot < 490:
            for x in quota:
                assert abs(done[x] - (slot + 1) * quota[x] / whole) < 1 + 1e-9
    assert all(done[s] == -(-q // block) for s, q in quota.items())
    assert mixing.schedule({}, 10) == (1, [])


def corpus(spark, n=600):
    rnd = random.Random(1)
    data = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(rnd.randrange(0, 60))), rnd.choice(["big"] * 8 + ["mid"] * 3 + ["small", None]), "x", 3) for i in range(n)]
    data += [(n, None, "mid", "x", 3), (n + 1, "", "mid", "x", 3), (None, "alpha beta", "mid", "x", 3), (n + 2, "long " * 50_000, "big", "x", 3)]
    return spark.createDataFrame(data, "doc_id long, text string, source string, bucket string, slot int")


def test_mix(spark):
    docs = corpus(spark)
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.3, 2), ("small", 0.2, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    m = mixing.mix(docs, targets, slots=64, buckets=8)
    again = mixing.mix(docs.repartition(7), targets, slots=64, buckets=8)
    assert rows(m.documents) == rows(again.documents)
    report = {r["source"]: r for r in m.report().collect()}
    assert set(report) == {"big", "mid", "small", "absent", None}
    assert report["absent"]["mixed_tokens"] == 0 and report[None]["mixed_tokens"] == 0
    for s in ("big", "mid", "small"):
        r = report[s]
        assert r["times_used"] <= r["max_repeats"] and r["mixed_tokens"] >= r["quota_tokens"] - 1
    assert report["small"]["capped"] and sum(r["actual_share"] for r in report.values()) == pytest.approx(1)
    uses = defaultdict(int)
    for r in m.documents.collect():
        uses[r["source"], r["doc_id"], r["repeat"]] += 1
    assert set(uses.values()) == {1}
    assert mixing.mix(docs.limit(0), targets).documents.count() == 0
    assert mixing.mix(docs, targets.limit(0)).report().count() == 4


def test_tokens_are_those_of_the_documented_pattern(spark):
    import public_tokenizers
    import tiktoken

    own = mixing.encoding(open(f"{mixing.TOKENIZER_DIR}/{mixing.VOCABULARY}", "rb").read())
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own._mergeable_ranks, special_tokens={})
    rnd = random.Random(2)
    for _ in range(300):
        text = "".join(rnd.choice("ab'sS 1\n\t ,;é漢'll") for _ in range(rnd.randrange(60)))
        assert own.encode_ordinary(text) == plain.encode_ordinary(text)
