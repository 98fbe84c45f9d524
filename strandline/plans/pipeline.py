"""Queries on the general training-data operators: parsing with faults, and heavy keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import chunks
from strandline.schema import BASE_OF_CODE, BEDMETHYL_COLUMNS
from strandline.session import table
from strandline.sources import lines

HEAVY_SHARE = 0.04


def _parsed(spark: SparkSession, d: str, keep: list[str], only_errors: bool = True) -> DataFrame:
    return lines.parse_lines(table(spark, d, "bedmethyl_lines"), table(spark, d, "contigs"), keep, file="file_name", number="line_no", only_errors=only_errors)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are no valid record."""
    return lines.errors(_parsed(spark, d, ["line_id"]), ["line_id"]).select("line_id").distinct()


def p3_errors(spark: SparkSession, d: str) -> DataFrame:
    """Where and why each of them failed."""
    keep = ["line_id", "file_name", "line_no"]
    return lines.errors(_parsed(spark, d, keep), keep)


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    """The valid records, typed."""
    return lines.records(_parsed(spark, d, ["line_id"], only_errors=False))


# what is totalled per chrom: name, SQL expression
_GOOD = "case when {0} between 0 and 1 and not isnan({0}) then {0} end"
TOTALS = {
    "bedmethyl": {"coverage": "valid_coverage", "modified": "count_modified", "calls": "valid_coverage + count_fail", "quality": "0"},
    "read_calls": {"coverage": "1", "modified": "case when call_code <> '-' then 1 end", "calls": "case when not fail then 1 end", "quality": _GOOD.format("call_prob")},
    "read_mods": {"coverage": "1", "modified": "case when mod_qual >= 0.5 and mod_qual <= 1 then 1 end", "calls": "case when not inferred then 1 end", "quality": _GOOD.format("mod_qual")},
}


def _by_table(spark: SparkSession, d: str, sums: bool) -> DataFrame:
    out = None
    for name, what in TOTALS.items():
        what = what if sums else {}
        states = chunks.chunk_states(table(spark, d, name), "chrom", what)
        own = chunks.key_totals(states, list(what))
        own = own if sums else chunks.heavy_keys(own, HEAVY_SHARE)
        own = own.withColumn("table_name", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The contigs that hold more than their share of a table's rows."""
    return _by_table(spark, d, False).select("table_name", F.col("key").alias("chrom"))


def p5_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals per chrom of three tables: coverage, modified counts, calls, quality."""
    whole = [F.col(c).cast("long").alias(c) for c in ("coverage", "modified", "calls")]
    return _by_table(spark, d, True).select("table_name", F.col("key").alias("chrom"), "n_rows", *whole, F.round("quality", 4).alias("quality"))


QUERIES = {f.__name__: f for f in (p3_found, p3_errors, p3_records, p5_found, p5_totals)}

_CODES = ", ".join(f"'{c}'" for c in BASE_OF_CODE)
_NUMBERS = [2, 3, 5, 7, 8, 10, 12, 13, 14, 15, 16, 17, 18]
_FIELD = '("[^"\\t]*"|[^"\\t]*)'
_SPACED = '("[^"\\t ]*"|[^"\\t ]*)'
_TABS = "\\t".join([_FIELD] * 18)
_MIXED = "\\t".join([_FIELD] * 9 + [_SPACED]) + (" " + _SPACED) * 8
_P3 = f"""
raw as (select line_id, line, regexp_replace(regexp_replace(line, '\\r$', ''), '\\t$', '') as body from bedmethyl_lines
        where not regexp_matches(line, '^\\s*$') and line not like '#%' and rtrim(line, chr(13)) <> '{chr(9).join(BEDMETHYL_COLUMNS)}'),
cut as (select line_id, case when regexp_full_match(body, '{_TABS}') then string_split(body, chr(9))
                             when regexp_full_match(body, '{_MIXED}') then string_split(replace(body, ' ', chr(9)), chr(9)) end as q from raw),
f as (select line_id, case when q is null then null else list_transform(q, lambda x: trim(x, '"')) end as f from cut),
n as (select line_id, f, {", ".join(f"case when regexp_full_match(f[{k}], '[0-9]+') then try_cast(f[{k}] as bigint) end as n{k}" for k in _NUMBERS)} from f),
ok as (select n.line_id, f, {", ".join(f"n{k}" for k in _NUMBERS)} from n join contigs c on c.chrom = f[1]
       where {" and ".join(f"n{k} is not null" for k in _NUMBERS)}
       and n3 = n2 + 1 and n3 <= c.size and n7 = n2 and n8 = n3
       and regexp_full_match(f[4], '[^,]+(,[ACGTUNRYSWKMBDHVX]+,[0-9]+)?') and string_split(f[4], ',')[1] in ({_CODES})
       and f[6] in ('+', '-', '.') and f[9] = '255,0,0' and n5 = n10 and n10 = n12 + n13 + n14 and n10 >= 1
       and regexp_full_match(f[11], '[0-9]+\\.[0-9][0-9]') and abs(round(f[11]::double * 100)::bigint * n10 - 10000 * n12) * 10 <= 11 * n10)"""
_COLUMN = {k: f"n{k}" for k in _NUMBERS} | {11: "f[11]::double"}


def _totals_sql(name: str) -> str:
    return f"select '{name}' as table_name, chrom, count(*) as n_rows, " + ", ".join(
        f"coalesce(sum(({e})::double), 0)" + ("::bigint" if c != "quality" else "") + f" as {c}" for c, e in TOTALS[name].items()
    ).replace("as quality", "as q0") + f" from {name} group by chrom"


ORACLES = {
    "p3_found": f"with {_P3} select line_id from raw where line_id not in (select line_id from ok)",
    "p3_records": f"with {_P3} select line_id, " + ", ".join(f'{_COLUMN.get(k, f"f[{k}]")} as "{c}"' for k, c in enumerate(BEDMETHYL_COLUMNS, 1)) + " from ok",
    "p5_found": " union all ".join(f"select '{t}' as table_name, chrom from {t} where chrom is not null group by chrom having count(*) > {HEAVY_SHARE} * (select count(*) from {t})" for t in TOTALS),
    "p5_totals": "select * exclude (q0), round(q0, 4) as quality from (" + " union all ".join(map(_totals_sql, TOTALS)) + ")",
}
