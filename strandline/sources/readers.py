"""Readers of the domain's text formats, as DataFrames.

Files are read with Spark's text source, so plain files are split and compressed ones are
read whole.  Rows that can't be read are left out of these readers' results; use
``sources.lines`` where they must be told apart with a reason.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.seq import Motif
from strandline.schema import BASE_OF_CODE, BEDMETHYL_COLUMNS, BEDMETHYL_SCHEMA


def _lines(spark: SparkSession, path: str) -> DataFrame:
    line = F.regexp_replace("value", r"[\r\t]+$", "")
    return spark.read.text(path).select(line.alias("line")).where("trim(line) <> '' and not startswith(line, '#')")


def _long(c: Column) -> Column:
    return c.try_cast("long")


def bedmethyl(spark: SparkSession, path: str, min_coverage: int = 0, known_codes_only: bool = False) -> DataFrame:
    """Pileup tables, fields parted by tabs or blanks; ``code`` is the name without motif."""
    parts = _lines(spark, path).select(F.split("line", r"[ \t]+").alias("f"))
    cols = [F.try_element_at("f", F.lit(i + 1)).try_cast(BEDMETHYL_SCHEMA[c].dataType).alias(c) for i, c in enumerate(BEDMETHYL_COLUMNS)]
    out = parts.where(F.size("f") == len(BEDMETHYL_COLUMNS)).select(*cols, F.split(F.col("f")[3], ",")[0].alias("code"))
    out = out.where("chromStart is not null and valid_coverage is not null").where(F.col("valid_coverage") >= min_coverage)
    return out.where(F.col("code").isin(*BASE_OF_CODE)) if known_codes_only else out


def regions(spark: SparkSession, path: str) -> DataFrame:
    """BED with 3 or 4 fields (both strands) or 6 and more (stranded).  Fields are parted
    by tabs, a file without tabs by blanks; a name may hold blanks; without one it is
    ``chrom:start-end``."""
    tabbed = F.split("line", "\t")
    loose = F.split("line", " +", 4)
    f = _lines(spark, path).select(F.when(F.contains("line", F.lit("\t")), tabbed).otherwise(loose).alias("f"))
    g = lambda i: F.try_element_at("f", F.lit(i))
    strand = F.when((F.size("f") >= 6) & g(6).isin("+", "-"), g(6)).otherwise(".")
    name = F.coalesce(F.nullif(g(4), F.lit("")), F.concat(g(1), F.lit(":"), g(2), F.lit("-"), g(3)))
    return f.select(g(1).alias("chrom"), _long(g(2)).alias("start"), _long(g(3)).alias("end"), name.alias("region_name"), strand.alias("strand")).where("end > start")


def position_filter(spark: SparkSession, path: str) -> DataFrame:
    """BED3 covers both strands, BED6 its own; other widths are left out."""
    f = _lines(spark, path).select(F.split("line", "[ \t]+").alias("f")).where((F.size("f") == 3) | (F.size("f") >= 6))
    g = lambda i: F.try_element_at("f", F.lit(i))
    strand = F.when(F.size("f") == 3, ".").when(g(6).isin("+", "-", "."), g(6))
    return f.select(g(1).alias("chrom"), _long(g(2)).alias("start"), _long(g(3)).alias("end"), strand.alias("strand")).where("end > start and strand is not null")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """BED6 whose name is a code, or ``-`` for canonical."""
    f = _lines(spark, path).select(F.split("line", "[ \t]+").alias("f")).where(F.size("f") >= 6)
    g = lambda i: F.try_element_at("f", F.lit(i))
    out = f.select(g(1).alias("chrom"), _long(g(2)).alias("start"), _long(g(3)).alias("end"), g(4).alias("code"), g(6).alias("strand"))
    return out.where((F.col("code") == "-") | F.col("code").isin(*BASE_OF_CODE)).where("end > start")


def fasta(spark: SparkSession, path: str, mask: bool = False) -> DataFrame:
    """(chrom, seq) of each record; upper case unless ``mask``."""
    rows = spark.read.text(path, lineSep=">").where("trim(value) <> ''")
    name = F.regexp_extract("value", r"^(\S+)", 1)
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return rows.select(name.alias("chrom"), (seq if mask else F.upper(seq)).alias("seq")).where("chrom <> ''")


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """Genome sizes or a FASTA index: name and length are the first two fields."""
    f = _lines(spark, path).select(F.split("line", "[ \t]+").alias("f"))
    return f.select(F.col("f")[0].alias("chrom"), _long(F.try_element_at("f", F.lit(2))).alias("size")).where("size is not null")


def known_motifs(spark: SparkSession, path: str) -> list[tuple[str, Motif]]:
    """(code, motif) rows of a small table ``mod_code motif offset`` with a header."""
    rows = _lines(spark, path).select(F.split("line", "[ \t]+").alias("f")).where((F.size("f") >= 3) & (F.col("f")[0] != "mod_code")).collect()
    return [(r["f"][0], Motif(r["f"][1], int(r["f"][2]))) for r in rows]


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Text SAM records in the schema of reads, with mate fields; header lines are left out
    (``sam_header``).  ``tags`` holds every auxiliary field but those of modified bases as
    text; ``aux`` all of them as they are, in order, for ``writers.write_sam``."""
    rows = spark.read.text(path).where("not startswith(value, '@') and trim(value) <> ''").select(F.split(F.regexp_replace("value", r"[\r\n]+$", ""), "\t").alias("f")).where(F.size("f") >= 11)
    g = lambda i: F.col("f")[i]
    raw = F.slice("f", F.lit(12), F.greatest(F.lit(0), F.size("f") - 11))
    aux = F.transform(raw, lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substring(t, 4, 1).alias("t"), F.substring(t, F.lit(6), F.length(t)).alias("v")))
    with_aux = rows.select("*", aux.alias("aux"), raw.alias("raw"))
    tag = lambda *names: F.try_element_at(F.filter("aux", lambda a: a["k"].isin(*names)), F.lit(1))["v"]
    missing = lambda c, none: F.when(c != none, c)
    parts = F.split(F.coalesce(tag("ML", "Ml"), F.lit("")), ",")
    ml = F.transform(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1)), lambda x: x.try_cast("int"))
    flag = g(1).try_cast("int")
    return with_aux.where(flag.isNotNull()).select(
        g(0).alias("read_id"), flag.alias("flag"), missing(g(2), "*").alias("chrom"), (_long(g(3)) - 1).alias("pos"), g(4).try_cast("int").alias("mapq"),
        missing(g(5), "*").alias("cigar"), missing(g(9), "*").alias("seq"), F.when(g(10) != "*", F.transform(F.split(g(10), ""), lambda c: F.ascii(c) - 33)).alias("qual"),
        tag("MM", "Mm").alias("mm"), ml.alias("ml"), tag("MN").try_cast("int").alias("mn"), (flag.bitwiseAND(16) != 0).alias("is_reverse"),
        # a field given twice counts as it is first
        F.map_from_entries(F.array_distinct(F.transform(F.filter("aux", lambda a, i: ~a["k"].isin("MM", "Mm", "ML", "Ml", "MN") & (F.array_position(F.transform(F.col("aux"), lambda x: x["k"]), a["k"]) == i + 1)), lambda a: F.struct(a["k"], a["v"])))).alias("tags"),
        missing(g(6), "*").alias("rnext"), (_long(g(7)) - 1).alias("pnext"), _long(g(8)).alias("tlen"), F.col("raw").alias("aux"),
    )


def sam_header(spark: SparkSession, path: str) -> list[str]:
    """The header lines of a SAM text, which are few."""
    return [r["value"] for r in spark.read.text(path).where("startswith(value, '@')").collect()]


def fasta_windows(spark: SparkSession, path: str, index: str, size: int = 1_000_000, overlap: int = 1000, mask: bool = False) -> DataFrame:
    """(chrom, start, core, seq): windows of the sequences, read by byte ranges that the
    index (name, length, offset, bases and bytes of a line) gives, so that a chromosome is
    read by many tasks, a window at a time.  ``seq`` goes ``overlap`` bases beyond the
    window's ``core`` bases on its right and starts ``before`` bases to its left."""
    f = _lines(spark, index).select(F.split("line", "[ \t]+").alias("f")).where(F.size("f") >= 5)
    n = lambda i: _long(F.try_element_at("f", F.lit(i)))
    rows = f.select(F.col("f")[0].alias("chrom"), n(2).alias("length"), n(3).alias("offset"), n(4).alias("bases"), n(5).alias("width")).where("length > 0 and bases > 0")
    wins = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, at = pa_fs.FileSystem.from_uri(path) if "://" in path else (pa_fs.LocalFileSystem(), path)
        with source.open_input_file(at) as file:
            for frame in frames:
                for r in frame.itertuples(index=False):
                    a, b = max(0, r.start - overlap), min(r.length, r.start + size + overlap)
                    first, last = (r.offset + x // r.bases * r.width + x % r.bases for x in (a, b))
                    file.seek(first)
                    seq = re.sub(rb"\s", b"", file.read(last - first)).decode("ascii", "replace")
                    yield pd.DataFrame({"chrom": [r.chrom], "start": [r.start], "before": [r.start - a], "core": [min(size, r.length - r.start)], "seq": [seq if mask else seq.upper()]})

    return wins.repartition("chrom", "start").mapInPandas(read, "chrom string, start long, before long, core long, seq string")
