"""A sample by key that stays the same when data is rerun, repartitioned or grows.

A record is selected if the hash of its normalised key, with a fixed salt, falls below
the rate on the unit interval.  Nothing but the key and the salt enters, so the decision
is the same in every table, run and partitioning; later data can't undo it; and a higher
rate only adds keys.  MD5 is used because every engine has it and gives the same sample.

Defined results: null and blank keys are never selected; a key in another letter case
or with surrounding blanks is the same key; repeated rows of a selected key are all
selected; an empty table gives an empty sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALT = "strandline/sample/1"
_DIGITS = 13  # hexadecimal digits compared: 52 bits, exact as a double


def sample_key(key: Column) -> Column:
    k = F.lower(F.trim(key.cast("string")))
    return F.when(k != "", k)


def _hash(key: Column, salt: str) -> Column:
    return F.substring(F.md5(F.concat(F.lit(salt + "/"), key)), 1, _DIGITS)


def unit(key: Column, salt: str = SALT) -> Column:
    """The key's place on [0, 1)."""
    return F.conv(_hash(key, salt), 16, 10).cast("double") / F.lit(16.0**_DIGITS)


def selected(key: Column, rate: float, salt: str = SALT) -> Column:
    """Whether the (normalised) key is in the sample; compares the digits as text."""
    if not 0 <= rate <= 1:
        raise ValueError("a rate is from 0 to 1")
    bound = min(int(rate * 16**_DIGITS), 16**_DIGITS)
    if bound == 16**_DIGITS:
        return key.isNotNull()
    return F.coalesce(_hash(key, salt) < F.lit(f"{bound:0{_DIGITS}x}"), F.lit(False))


def sample_rows(rows: DataFrame, key: str, rate: float, salt: str = SALT) -> DataFrame:
    """The selected rows with ``sample_key`` added (replacing a column of that name); no shuffle."""
    out = rows.withColumn("sample_key", sample_key(F.col(key)))
    return out.where(selected(F.col("sample_key"), rate, salt))


def sample_reads(tables: dict[str, DataFrame], key: str, rate: float, day: str, salt: str = SALT) -> DataFrame:
    """One row per selected key: its place on the unit interval, the first and last day
    and the rows it has in each table (0 where it has none)."""
    parts = []
    for name, t in tables.items():
        rows = t.select(sample_key(F.col(key)).alias("sample_key"), F.col(day).alias("day"))
        rows = rows.where(selected(F.col("sample_key"), rate, salt))
        parts.append(rows.groupBy("sample_key", F.lit(name).alias("t")).agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day")))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    n = [F.coalesce(F.sum(F.when(F.col("t") == name, F.col("n"))), F.lit(0)).cast("long").alias(f"n_{name}") for name in tables]
    return all_.groupBy("sample_key").agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), *n).withColumn("place", unit(F.col("sample_key"), salt))


def growth(tables: dict[str, DataFrame], key: str, rate: float, day: str, salt: str = SALT) -> DataFrame:
    """For each day: keys met for the first time and those of them selected, and both
    counted up to that day.  A key is counted on its first day only, so the selected of
    a day are those of the day before plus the new ones."""
    seen = None
    for t in tables.values():
        rows = t.select(sample_key(F.col(key)).alias("k"), F.col(day).alias("day")).where("k is not null and day is not null")
        rows = rows.groupBy("k").agg(F.min("day").alias("day"))
        seen = rows if seen is None else seen.unionByName(rows)
    first = seen.groupBy("k").agg(F.min("day").alias("day"))
    by_day = first.groupBy("day").agg(F.count("*").alias("new_keys"), F.sum(selected(F.col("k"), rate, salt).cast("long")).alias("new_selected"))
    # one row per day from here on
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return by_day.select("day", "new_keys", "new_selected", F.sum("new_keys").over(w).alias("keys"), F.sum("new_selected").over(w).alias("selected"))
