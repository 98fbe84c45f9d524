"""Per-key results when a few keys hold most rows: exact offset chunking.

1. Count the rows of each key in each input partition.
2. Prefix sums over the partitions give, for every partition, the number of the first
   row of each key in it.
3. Rows are numbered where they lie, before anything is shuffled; ``chunk = number //
   chunk_rows`` cuts each key into chunks of equal size, wherever the input partitions end.
4. Chunks are processed: ``chunk_states`` folds them into sums (combined on the map side,
   so no row is shuffled), ``apply_chunks`` hands each to a function as a data frame of at
   most ``chunk_rows`` rows, so that a key with most rows is spread over many tasks.
5. States of the chunks of a key are merged in order, so they may depend on the row order
   at chunk borders (``key_totals``, ``merge_in_order``).

The input must be read alike in both passes (a table's files are); if a partition turns
out to hold other rows than were counted, the query fails instead of numbering wrongly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.session import attach, materialize

CHUNK_ROWS = 100_000


def _name(key: Column) -> Column:
    """The key as text; empty for null."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))


def key_offsets(rows: DataFrame, key: str) -> DataFrame:
    """(part, key, n, offset): rows of each key in each input partition, and those before it."""
    counted = rows.groupBy(F.spark_partition_id().alias("part"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0)))


def numbered(rows: DataFrame, key: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The rows with ``_number``, the row's place among those of its key (null keys are a
    key of their own), and ``_chunk``.

    Rows get their place within the partition by a counter of the task that reads it; the
    partition's offset is added afterwards, by a join that may shuffle."""
    offsets = materialize(key_offsets(rows.select(key), key).select("part", _name(F.col("key")).alias("_name"), F.col("n").alias("_n"), "offset"))
    # keys of other types than text are told apart by their text, as in the offsets
    plain = isinstance(rows.schema[key].dataType, T.StringType)
    name = key if plain else "_text"
    sent = rows.select("*", F.spark_partition_id().alias("part"), *([] if plain else [F.col(key).cast("string").alias(name)]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sent.schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str | None, int] = {}
        for batch in batches:
            keys = batch.column(name).dictionary_encode("encode")
            code, names = keys.indices.to_numpy(zero_copy_only=False), keys.dictionary.to_pylist()
            by = np.argsort(code, kind="stable")
            size = np.bincount(code, minlength=len(names))
            place = np.empty(len(code), np.int64)
            place[by] = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
            place += np.array([seen.get(n, 0) for n in names], np.int64)[code]
            for n, c in zip(names, size.tolist()):
                seen[n] = seen.get(n, 0) + c
            yield batch.append_column("_place", pa.array(place))

    placed = sent.mapInArrow(number, f"{schema}, _place long").withColumn("_name", _name(F.col(key)))
    out = attach(placed, offsets, ["part", "_name"], how="left")
    other = F.raise_error(F.lit("an input partition holds other rows than were counted"))
    place = F.when(F.col("_n").isNull() | (F.col("_place") >= F.col("_n")), other.cast("long")).otherwise(F.col("offset") + F.col("_place"))
    return out.withColumn("_number", place).withColumn("_chunk", F.expr(f"_number div {chunk_rows}")).select(*rows.columns, "_number", "_chunk")


def chunk_states(rows: DataFrame, key: str, sums: dict[str, str], order: str | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(key, chunk, n_rows, sums, first_<order>, last_<order>): the merged state of each chunk.

    ``sums``: output name to a numeric SQL expression.  Nulls and NaN add nothing; null
    keys are chunked like any other.  ``order`` names a column of which the first and
    the last value in row order are kept."""
    narrow = rows.select(
        F.col(key).alias("key"),
        *[F.expr(e).cast("double").alias(f"s_{name}") for name, e in sums.items()],
        *([F.col(order).cast("double").alias("o")] if order else []),
    )
    finite = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c))
    merged = [F.count("*").alias("n_rows"), *[F.coalesce(F.sum(finite(f"s_{name}")), F.lit(0.0)).alias(name) for name in sums]]
    if order:
        merged += [F.min_by("o", "_number").alias(f"first_{order}"), F.max_by("o", "_number").alias(f"last_{order}")]
    return numbered(narrow, "key", chunk_rows).groupBy("key", F.col("_chunk").alias("chunk")).agg(*merged)


def apply_chunks(rows: DataFrame, key: str, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``run`` is given every chunk of every key, in row order, with ``_number`` and
    ``_chunk``; its rows come out with ``_chunk`` in front.  A task holds at most one chunk
    at a time."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("_number")
        out = run(f)
        out.insert(0, "_chunk", f["_chunk"].iloc[0])
        return out

    return numbered(rows, key, chunk_rows).groupBy(key, "_chunk").applyInPandas(one, f"_chunk long, {schema}")


def merge_in_order(states: DataFrame, key: str, carry: str, chunk: str = "_chunk") -> DataFrame:
    """Adds ``before``: the sum of ``carry`` over the chunks of the key before this one (the
    state at the chunk's start).  One row per chunk is sorted, not the key's rows."""
    w = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return states.withColumn("before", F.coalesce(F.sum(carry).over(w), F.lit(0)))


def key_totals(chunks: DataFrame, sums: list[str], order: str | None = None) -> DataFrame:
    """Merges the chunks of each key in order: rows, chunks, sums and, with ``order``,
    the first and last value of the key's rows."""
    merged = [F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_chunks"), *[F.sum(c).alias(c) for c in sums]]
    if order:
        merged += [F.min_by(f"first_{order}", "chunk").alias(f"first_{order}"), F.max_by(f"last_{order}", "chunk").alias(f"last_{order}")]
    return chunks.groupBy("key").agg(*merged)


def heavy_keys(totals: DataFrame, share: float) -> DataFrame:
    """Keys, null excluded, that hold more than ``share`` of all rows."""
    totals = materialize(totals)  # one row per key; made once, read twice
    whole = totals.agg(F.sum("n_rows").alias("all_rows"))  # one row
    return totals.join(F.broadcast(whole)).where((F.col("n_rows") > share * F.col("all_rows")) & F.col("key").isNotNull())
