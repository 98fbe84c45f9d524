"""The driver's contract: names, SQL and the flagship query."""

import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.exists(SMALL), reason="needs the driver's tables")
def test_flagship(spark):
    bed = entry.entry(spark)
    assert bed.columns[:4] == ["chrom", "chromStart", "chromEnd", "name"] and bed.count() > 0
    assert bed.where("valid_coverage <> count_modified + count_canonical + count_other_mod or valid_coverage < 1").count() == 0
    assert bed.where("score <> valid_coverage or abs(percent_modified - 100 * count_modified / valid_coverage) > 0.0051").count() == 0
