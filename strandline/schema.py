"""Names, types and vocabulary of the domain's tables."""

from __future__ import annotations

from pyspark.sql import Column, types as T
from pyspark.sql import functions as F

# Modification codes by primary base.  Upper-case letters mean any modification of the base.
CODES_BY_BASE = {
    "C": ("m", "h", "f", "c", "21839", "C"),
    "A": ("a", "A", "17596"),
    "T": ("g", "e", "b", "T", "17802", "16450"),
    "G": ("o", "G"),
}
BASE_OF_CODE = {code: base for base, codes in CODES_BY_BASE.items() for code in codes}
COMPLEMENT = {"A": "T", "C": "G", "G": "C", "T": "A"}

# Columns of a pileup table, in order.
BEDMETHYL_COLUMNS = (
    "chrom chromStart chromEnd name score strand thickStart thickEnd color valid_coverage percent_modified "
    "count_modified count_canonical count_other_mod count_delete count_fail count_diff count_nocall"
).split()
COUNT_COLUMNS = BEDMETHYL_COLUMNS[11:]
COLOR = "255,0,0"

_TEXT = {"chrom", "name", "strand", "color"}
BEDMETHYL_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType() if c in _TEXT else T.DoubleType() if c == "percent_modified" else T.LongType()) for c in BEDMETHYL_COLUMNS]
)
READ_SCHEMA = T.StructType(
    [
        T.StructField("read_id", T.StringType()),
        T.StructField("flag", T.IntegerType()),
        T.StructField("chrom", T.StringType()),
        T.StructField("pos", T.LongType()),
        T.StructField("mapq", T.IntegerType()),
        T.StructField("cigar", T.StringType()),
        T.StructField("seq", T.StringType()),
        T.StructField("qual", T.ArrayType(T.IntegerType())),
        T.StructField("mm", T.StringType()),
        T.StructField("ml", T.ArrayType(T.IntegerType())),
        T.StructField("mn", T.IntegerType()),
        T.StructField("is_reverse", T.BooleanType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    ]
)
CALL_TYPE = "read_id string, read_no long, flag int, chrom string, fwd_pos int, ref_pos long, mod_strand string, aln_strand string, base string, probs map<string,double>, inferred boolean, explicit boolean, read_len int"


_BASE_MAP = "map(" + ", ".join(f"'{c}', '{b}'" for c, b in BASE_OF_CODE.items()) + ")"


def base_of_code(code: Column) -> Column:
    return F.try_element_at(F.expr(_BASE_MAP), code)


def complement(base: Column) -> Column:
    return F.translate(base, "ACGT", "TGCA")


def code_order(code: Column) -> Column:
    """Sort key of codes: ChEBI numbers first, by value, then letters."""
    number = code.try_cast("bigint")
    return F.struct(number.isNull().alias("letter"), F.coalesce(number, F.lit(0)).alias("number"), code.alias("code"))
