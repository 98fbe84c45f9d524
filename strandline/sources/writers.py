"""Writers of the domain's text formats.  A path that exists is an error unless ``force``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.schema import BEDMETHYL_COLUMNS, COLOR, code_order


def _mode(force: bool) -> str:
    return "overwrite" if force else "error"


def bedmethyl_line(mixed: bool = False) -> Column:
    """The text of a row: tabs throughout, or blanks after field 10."""
    f = [F.format_string("%.2f", F.col(c)) if c == "percent_modified" else F.col(c).cast("string") for c in BEDMETHYL_COLUMNS]
    if mixed:
        return F.concat_ws("\t", *f[:9], F.concat_ws(" ", *f[9:]))
    return F.concat_ws("\t", *f)


def write_bedmethyl(rows: DataFrame, path: str, mixed: bool = False, header: bool = False, force: bool = False, partition: str | None = None, compression: str | None = None) -> None:
    """Sorted by chrom, position, strand and code.  ``header`` starts every part file
    with the column names and can't be used with ``partition`` (a directory per key)."""
    if header and partition:
        raise ValueError("partitioned output has no header")
    ordered = rows.orderBy("chrom", "chromStart", "strand", code_order(F.split("name", ",")[0]), "name")
    extra = [partition] if partition else []
    if header:
        text = ordered.select(*[F.format_string("%.2f", F.col(c)).alias(c) if c == "percent_modified" else F.col(c) for c in BEDMETHYL_COLUMNS])
        text.write.mode(_mode(force)).csv(path, sep="\t", header=True, quote="", compression=compression or "none")
        return
    out = ordered.select(*extra, bedmethyl_line(mixed).alias("value")).write.mode(_mode(force))
    if partition:
        out = out.partitionBy(partition)
    out.text(path, compression=compression)


def hemi_bedmethyl(patterns: DataFrame) -> DataFrame:
    """Patterns of both strands (``operators.pileup.pileup_hemi``) in the 18 columns of a
    pileup table: the name is the pattern, the strand is always ``.``."""
    valid, end = F.col("valid_coverage"), F.col("ref_pos") + 1
    none = F.lit(0).cast("long")
    return patterns.select(
        "chrom", F.col("ref_pos").alias("chromStart"), end.alias("chromEnd"), F.col("pattern").alias("name"), valid.alias("score"), F.lit(".").alias("strand"),
        F.col("ref_pos").alias("thickStart"), end.alias("thickEnd"), F.lit(COLOR).alias("color"), "valid_coverage", F.round(100.0 * F.col("n") / valid, 2).alias("percent_modified"),
        F.col("n").alias("count_modified"), F.col("n_canonical").alias("count_canonical"), F.col("n_other").alias("count_other_mod"), none.alias("count_delete"),
        F.col("n_fail").alias("count_fail"), none.alias("count_diff"), F.col("n_nocall").alias("count_nocall"),
    )


def read_order(rows: DataFrame) -> DataFrame:
    """Read-level rows read by read in the order of the reference: by position in the
    read, from its end for reads aligned to −."""
    along = F.when(F.col("ref_strand") == "-", -F.col("fwd_pos")).otherwise(F.col("fwd_pos"))
    return rows.repartition("read_id").sortWithinPartitions("read_id", "flag", along, "mod_strand", "base")


def write_bedgraph(rows: DataFrame, path: str, force: bool = False) -> None:
    """chrom, start, end, fraction and coverage; a directory per code and strand."""
    strand = F.when(F.col("strand") == "+", "positive").when(F.col("strand") == "-", "negative").otherwise("combined")
    line = F.concat_ws("\t", "chrom", "chromStart", "chromEnd", (F.col("count_modified") / F.col("valid_coverage")).cast("string"), "valid_coverage")
    rows.orderBy("chrom", "chromStart").select(F.col("name").alias("code"), strand.alias("side"), line.alias("value")).write.mode(_mode(force)).partitionBy("code", "side").text(path)


def write_tsv(rows: DataFrame, path: str, header: bool = True, force: bool = False, compression: str | None = None) -> None:
    """Any result without nested columns; nulls are written as ``.``."""
    rows.write.mode(_mode(force)).csv(path, sep="\t", header=header, nullValue=".", emptyValue="", compression=compression or "none")


def sam_line(columns: list[str]) -> Column:
    """A read as a text SAM record.  Its auxiliary fields (``aux``) stay as they are and
    where they are; those of modified bases are written from ``mm``, ``ml`` and ``mn``, at
    the place of the old ones or at the end, and vanish where these are null."""
    have = lambda c, other: F.coalesce(c, F.lit(other)) if c is not None else F.lit(other)
    col = lambda c: F.col(c).cast("string") if c in columns else None
    place = lambda c: (F.col(c) + 1).cast("string") if c in columns else None
    new = {
        "MM": F.when(F.col("mm").isNotNull(), F.concat(F.lit("MM:Z:"), F.col("mm"))),
        "ML": F.when(F.col("mm").isNotNull() & F.col("ml").isNotNull(), F.concat_ws(",", F.lit("ML:B:C"), F.col("ml").cast("array<string>"))),
        "MN": F.when(F.col("mn").isNotNull(), F.concat(F.lit("MN:i:"), F.col("mn").cast("string"))),
    }
    old = F.coalesce(F.col("aux"), F.array().cast("array<string>")) if "aux" in columns else F.array().cast("array<string>")
    kind = lambda t: F.upper(F.substring(t, 1, 2))
    is_own = lambda t: F.substring(t, 1, 2).isin("MM", "Mm", "ML", "Ml", "MN")
    kept = F.transform(old, lambda t: F.when(is_own(t), F.when(kind(t) == "MM", new["MM"]).when(kind(t) == "ML", new["ML"]).otherwise(new["MN"])).otherwise(t))
    there = F.transform(F.filter(old, is_own), kind)
    added = F.array(*[F.when(~F.array_contains(there, k), v) for k, v in new.items()])
    tags = F.array_compact(F.concat(kept, added))
    qual = F.array_join(F.transform("qual", lambda q: F.char(q + 33)), "") if "qual" in columns else None
    core = [
        F.col("read_id"), F.col("flag").cast("string"), have(col("chrom"), "*"), have(place("pos"), "0"), have(col("mapq"), "255"), have(col("cigar"), "*"),
        have(col("rnext"), "*"), have(place("pnext"), "0"), have(col("tlen"), "0"), have(col("seq"), "*"), have(qual, "*"),
    ]
    return F.array_join(F.concat(F.array(*core), tags), "\t")


def program_record(header: list[str], name: str, version: str, command: str) -> list[str]:
    """The header with an @PG record of this program appended to the chain: its id is
    made unique, and it names the last program before it."""
    ids = [f[3:] for line in header if line.startswith("@PG") for f in line.split("\t") if f.startswith("ID:")]
    own, n = name, 1
    while own in ids:
        own, n = f"{name}.{n}", n + 1
    fields = ["@PG", f"ID:{own}", f"PN:{name}", f"VN:{version}", f"CL:{command}", *([f"PP:{ids[-1]}"] if ids else [])]
    return [*header, "\t".join(fields)]


def write_sam(reads: DataFrame, path: str, force: bool = False, header: list[str] | None = None) -> None:
    """Records as text; ``header`` goes to a part file of its own that sorts first."""
    reads.select(sam_line(reads.columns).alias("value")).write.mode(_mode(force)).text(path)
    if header:
        spark = reads.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path, "header.sam")
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, force)
        try:
            out.write(bytearray("".join(line + "\n" for line in header), "utf-8"))
        finally:
            out.close()
