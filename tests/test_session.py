import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from strandline import session
from tests.conftest import rows

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_materialize_and_release(spark):
    df = spark.range(5).withColumn("x", F.lit(None).cast("string"))
    kept = session.materialize(df)
    assert rows(kept) == rows(df) and kept.dtypes == df.dtypes
    session.release(kept)
    session.release(df)
    with pytest.raises(Exception):
        spark.read.parquet(kept._strandline_path)


def test_shared_folder_is_the_sessions(spark):
    assert session.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_usable(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-0.5,), (0.5,), (2.0,)], "v double")
    assert rows(df.where(session.usable(F.col("v"), 0, 1))) == [(0.5,)]


def test_workers_elsewhere_have_the_package(tmp_path):
    """A session that runs outside of this folder, with the package only on the driver's path."""
    spark_code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
from strandline import session
from strandline.functions.seq import Motif
from strandline.operators.motifs import motif_hits
s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()
session.ship(s)
session.ship(s)
print('HITS', motif_hits(s.createDataFrame([('a', 'ACGT')], 'chrom string, seq string'), [Motif('CG', 0)]).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", spark_code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "HITS 2" in done.stdout, done.stderr[-2000:]
