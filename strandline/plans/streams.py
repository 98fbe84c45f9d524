"""Queries that run as streams to the end of what there is."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.plans import tables
from strandline.plans.binding import THRESHOLDS
from strandline.session import shared_folder
from strandline.streaming import calls


def t1_stream_pass(spark: SparkSession, d: str) -> DataFrame:
    """Passing rows of the read table, streamed into a table and then counted by code."""
    at = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    rows = calls.read_rows(spark, f"{d}/read_mods.parquet").select("read_id", "mod_qual", "mod_code", "canonical_base")
    calls.run_to_end(calls.pass_rows(rows, THRESHOLDS).where("passes"), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").groupBy(F.col("mod_code").alias("code"), F.col("canonical_base").alias("base")).agg(F.count("*").alias("n"))


def t2_stream_track(spark: SparkSession, d: str) -> DataFrame:
    """The track of two codes, from a stream of pileup rows."""
    at = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    calls.run_to_end(calls.track(calls.read_rows(spark, f"{d}/bedmethyl.parquet"), ["m", "h"]), f"{at}/out", f"{at}/state", "complete")
    return spark.read.parquet(f"{at}/out")


QUERIES = {"t1_stream_pass": t1_stream_pass, "t2_stream_track": t2_stream_track}
ORACLES = {
    "t2_stream_track": tables.ORACLES["c23_track"],
    "t1_stream_pass": "select mod_code as code, canonical_base as base, count(*) as n from read_mods where mod_qual between 0 and 1 and not isnan(mod_qual) "
    "and mod_qual::double >= case when mod_code = 'h' then 0.8 when canonical_base = 'A' then 0.6 else 0.7 end group by all"
}
