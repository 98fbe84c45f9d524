"""Site queries on small pileup tables."""

import pytest

from strandline.plans import QUERIES
from strandline.schema import COUNT_COLUMNS

COLUMNS = "sample_id string, chrom string, chromstart long, strand string, name string, valid_coverage long, " + ", ".join(f"{c} long" for c in COUNT_COLUMNS)


def folder(spark, path, data):
    """``data``: sample, position, code, coverage and modified count of each row."""
    rows = [(s, "chr1", p, "+", code, v, m, v - m, *[0] * (len(COUNT_COLUMNS) - 2)) for s, p, code, v, m in data]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/bedmethyl.parquet")
    return str(path)


def test_every_position_of_a_cell_counts(spark, tmp_path):
    d = folder(spark, tmp_path, [("smp_0001", 10_100, "m", 10, 9), ("smp_0001", 10_900, "m", 30, 3), ("smp_0001", 10_900, "m", 8, 8), ("smp_0001", 15_000, "h", 5, 5), ("smp_0002", 10_500, "m", 20, 5), ("smp_0002", 19_999, "m", 20, 10)])
    got = QUERIES["c12_site_p_values"](spark, d).collect()
    assert [(r["chrom"], r["chromstart"], r["strand"]) for r in got] == [("chr1", 10_000, "+")]
    # the row of 8 is an earlier delivery of the one of 30
    assert got[0]["effect_size"] == pytest.approx((9 + 3 + 5) / 45 - 15 / 40)
