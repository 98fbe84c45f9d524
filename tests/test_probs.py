import pytest
from pyspark.sql import functions as F

from strandline.functions import probs as P


def one(spark, column, probs=None, base="C"):
    df = spark.createDataFrame([(probs, base)], "p map<string,double>, base string")
    return df.select(column.alias("x")).first()["x"]


CASES = [
    # probabilities, thresholds, kind, code
    ({"m": 0.6, "h": 0.1}, P.Thresholds(0.5), "modified", "m"),
    ({"m": 0.3, "h": 0.3}, P.Thresholds(0.5), "filtered", None),
    ({"m": 0.1, "h": 0.2}, P.Thresholds(0.5), "canonical", None),
    ({"m": 0.6, "h": 0.1}, P.Thresholds(0.5, {"C": 0.9}), "filtered", None),
    ({"m": 0.6, "h": 0.1}, P.Thresholds(0.5, {"C": 0.9}, {"m": 0.55}), "modified", "m"),
    ({"m": 0.6, "h": 0.1}, P.Thresholds(0.9, {}, {"C": 0.55}), "modified", "m"),
    ({"m": 0.55, "h": 0.15}, P.Thresholds(0.2, {}, {"m": 0.8}), "canonical", None),  # the best survivor
    ({"m": 0.5}, P.Thresholds(0.1), "canonical", None),  # a tie
    ({"m": 0.4, "h": 0.4}, P.Thresholds(0.1), "modified", "h"),
    ({"m": 0.4, "21839": 0.4}, P.Thresholds(0.1), "modified", "21839"),
    ({}, P.Thresholds(0.5), "canonical", None),
]


@pytest.mark.parametrize("probs,thresholds,kind,code", CASES)
def test_threshold_call(spark, probs, thresholds, kind, code):
    got = one(spark, P.threshold_call(F.col("p"), F.col("base"), thresholds), probs)
    assert (got["kind"], got["code"]) == (kind, code)


def test_null_map(spark):
    assert one(spark, P.threshold_call(F.col("p"), F.col("base"), P.Thresholds())) is None
    assert one(spark, P.argmax_call(F.col("p"))) is None


def test_quals(spark):
    df = spark.range(256).select(P.prob_to_qual(P.qual_to_prob(F.col("id"))).alias("q"), "id")
    assert df.where("q <> id").count() == 0
    assert one(spark, P.prob_to_qual(F.lit(1.0))) == 255


def test_ignore_shares_equally(spark):
    got = one(spark, P.ignore(F.col("p"), "h"), {"m": 0.3, "h": 0.2, "f": 0.1})
    assert got == pytest.approx({"m": 0.3 + 0.2 / 3, "f": 0.1 + 0.2 / 3})
    assert one(spark, P.ignore(F.col("p"), "h"), {"h": 0.7}) == {}
    assert one(spark, P.ignore(F.col("p"), "h"), {"m": 0.7}) == {"m": 0.7}


def test_renormalise_and_convert(spark):
    assert one(spark, P.renormalise_without(F.col("p"), "h"), {"m": 0.3, "h": 0.5}) == pytest.approx({"m": 0.6})
    assert one(spark, P.convert(F.col("p"), "h", "m"), {"m": 0.3, "h": 0.5}) == pytest.approx({"m": 0.8})
    assert one(spark, P.convert(F.col("p"), "h", "f"), {"m": 0.3, "h": 0.5}) == pytest.approx({"m": 0.3, "f": 0.5})


def test_call_to_probs(spark):
    call = P.threshold_call(F.col("p"), F.col("base"), P.Thresholds(0.5))
    assert one(spark, P.call_to_probs(F.col("p"), call), {"m": 0.6, "h": 0.2}) == {"m": 1.0, "h": 0.0}
    assert one(spark, P.call_to_probs(F.col("p"), call), {"m": 0.1, "h": 0.2}) == {"m": 0.0, "h": 0.0}
    assert one(spark, P.call_to_probs(F.col("p"), call), {"m": 0.3, "h": 0.3}) is None


def test_edges(spark):
    df = spark.range(10).select(F.col("id"), P.within_edges(F.col("id"), F.lit(10), 2, 3).alias("in_"), P.within_edges(F.col("id"), F.lit(10), 2, 3, True).alias("out"))
    assert [r["id"] for r in df.where("in_").collect()] == [2, 3, 4, 5, 6]
    assert [r["id"] for r in df.where("out").collect()] == [0, 1, 7, 8, 9]
    assert df.select(P.within_edges(F.col("id"), F.lit(3), 2, 3).alias("x")).where("x").count() == 0


def test_thresholds_are_parsed():
    t = P.Thresholds.parse(["0.75", "C:0.8"]).with_mods(["h:0.9"])
    assert (t.default, t.per_base, t.per_mod) == (0.75, {"C": 0.8}, {"h": 0.9})
    assert P.Thresholds.parse([]).default == 0
    for bad in (["2"], ["x:0.5"], ["0.1", "0.2"]):
        with pytest.raises(ValueError):
            P.Thresholds.parse(bad)


def test_blocks_combine(spark):
    df = spark.createDataFrame([({"m": 0.4}, {"h": 0.5}), ({"m": 0.8}, {"h": 0.5}), (None, {"h": 0.5})], "a map<string,double>, b map<string,double>")
    assert [r["x"] for r in df.select(P.combine_blocks(F.col("a"), F.col("b")).alias("x")).collect()] == [{"m": 0.4, "h": 0.5}, None, {"h": 0.5}]
