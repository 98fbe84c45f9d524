from collections import Counter

from pyspark.sql import functions as F

from strandline.operators import chunks
from tests.conftest import rows


def table(spark, tmp_path, n=5000, files=6):
    df = spark.range(n).select(
        F.when(F.col("id") % 3 != 0, "hot").when(F.col("id") % 9 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("chrom"),
        F.when(F.col("id") % 11 == 0, float("nan")).when(F.col("id") % 13 == 0, None).otherwise(F.col("id").cast("double")).alias("v"),
        F.col("id").alias("n_rows"),
        F.lit(1).alias("chunk"),
    )
    df.repartition(files).write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


def test_totals_are_those_of_a_plain_grouping(spark, tmp_path):
    t = table(spark, tmp_path)
    states = chunks.chunk_states(t, "chrom", {"total": "v", "twice": "2 * n_rows"}, chunk_rows=100)
    got = {r["key"]: (r["n_rows"], r["total"], r["twice"]) for r in chunks.key_totals(states, ["total", "twice"]).collect()}
    good = F.when(~F.isnan("v"), F.col("v"))
    want = {r["chrom"]: (r["n"], r["s"] or 0.0, r["w"]) for r in t.groupBy("chrom").agg(F.count("*").alias("n"), F.sum(good).alias("s"), F.sum("n_rows").alias("w")).collect()}
    want = {k: (n, s, 2.0 * w) for k, (n, s, w) in want.items()}
    assert got == want


def test_chunks_are_of_equal_size(spark, tmp_path):
    t = table(spark, tmp_path)
    states = chunks.chunk_states(t, "chrom", {}, chunk_rows=100).collect()
    assert len({(r["key"], r["chunk"]) for r in states}) == len(states)
    per_key = Counter(r["key"] for r in states)
    for r in states:
        last = r["chunk"] == per_key[r["key"]] - 1
        assert r["n_rows"] == 100 or last and 0 < r["n_rows"] <= 100


def test_order_dependent_state(spark, tmp_path):
    t = table(spark, tmp_path, files=1).select("chrom", F.col("n_rows").alias("v"))
    states = chunks.chunk_states(t, "chrom", {}, order="v", chunk_rows=70)
    got = {r["key"]: (r["first_v"], r["last_v"]) for r in chunks.key_totals(states, [], order="v").collect()}
    in_order = {}
    for r in t.collect():
        in_order.setdefault(r["chrom"], []).append(float(r["v"]))
    assert got == {k: (v[0], v[-1]) for k, v in in_order.items()}


def test_heavy_keys_and_empty_tables(spark, tmp_path):
    t = table(spark, tmp_path)
    totals = chunks.key_totals(chunks.chunk_states(t, "chrom", {}), [])
    assert [r["key"] for r in chunks.heavy_keys(totals, 0.5).collect()] == ["hot"]
    empty = chunks.key_totals(chunks.chunk_states(t.limit(0), "chrom", {"a": "v"}), ["a"])
    assert rows(chunks.heavy_keys(empty, 0.1)) == []


def test_salted_path(spark, tmp_path, monkeypatch):
    """The way beyond the broadcast bound gives the same: chunks, their sizes and borders."""
    import strandline.session

    t = table(spark, tmp_path)
    states = lambda: rows(chunks.chunk_states(t, "chrom", {"s": "n_rows"}, "n_rows", chunk_rows=70), "key", "chunk", "n_rows", "s", "first_n_rows", "last_n_rows")
    want = states()
    monkeypatch.setattr(strandline.session, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert states() == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_numbers_are_unique_and_keys_of_any_type(spark, tmp_path):
    t = table(spark, tmp_path).withColumn("k", F.when(F.col("chrom") != "hot", F.col("n_rows") % 5 + 2**60))
    got = chunks.numbered(t, "k", 100).groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("_number").alias("d"), F.max("_number").alias("m"), F.max("_chunk").alias("c")).collect()
    assert len(got) == 6 and all(r["n"] == r["d"] == r["m"] + 1 and r["c"] == r["m"] // 100 for r in got)


def test_other_rows_than_were_counted(spark, tmp_path, monkeypatch):
    import pytest

    t = table(spark, tmp_path)
    real = chunks.key_offsets
    monkeypatch.setattr(chunks, "key_offsets", lambda rows, key: real(rows.where("rand(3) < 0.9"), key))
    with pytest.raises(Exception, match="other rows than were counted"):
        chunks.numbered(t, "chrom", 100).collect()


def test_chunks_are_processed_and_merged_in_order(spark, tmp_path):
    """Running sums of a hot key, chunk by chunk."""
    t = table(spark, tmp_path).select("chrom", F.col("n_rows").alias("v"))
    run = lambda f: f.assign(run=f["v"].cumsum())[["chrom", "_number", "v", "run"]]
    inside = chunks.apply_chunks(t, "chrom", run, "chrom string, _number long, v long, run long", 100)
    assert inside.groupBy("chrom", "_chunk").count().agg(F.max("count")).first()[0] <= 100
    states = inside.groupBy("chrom", "_chunk").agg(F.max_by("run", "_number").alias("total"))
    whole = inside.alias("i").join(chunks.merge_in_order(states, "chrom", "total").alias("s"), F.col("i.chrom").eqNullSafe(F.col("s.chrom")) & (F.col("i._chunk") == F.col("s._chunk")))
    got = {}
    for r in whole.selectExpr("i.chrom as chrom", "_number", "v", "run + before as run").orderBy("_number").collect():
        so_far = got.setdefault(r["chrom"], [0])
        so_far.append(so_far[-1] + r["v"])
        assert so_far[-1] == r["run"]
    assert sum(len(x) - 1 for x in got.values()) == 5000
