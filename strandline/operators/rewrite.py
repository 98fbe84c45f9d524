"""Tagged reads with their calls adjusted or replaced by the called class; every other
field stays as it is.

A read's calls travel as one array, so nothing is shuffled and records of one name are no
trouble; both operators run on streams too.  Positions that a tag only implies are written
out, with mode ``?``.  Reads without tags, and those whose tags are erroneous
(``tags.check_tags`` tells), stay as they are; a read that has no call left loses its tags.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import probs as P
from strandline.functions import tags
from strandline.schema import complement

_CALLS = "array<struct<mod_strand:string,base:string,fwd_pos:int,probs:map<string,double>>>"
_ARROW = pa.list_(pa.struct([("mod_strand", pa.string()), ("base", pa.string()), ("fwd_pos", pa.int32()), ("probs", pa.map_(pa.string(), pa.float64()))]))


def _rewritten(reads: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    """``change``: the array of calls of a read to the new one."""

    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reads.schema)

    def columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
        return zip(*[batch.column(n).to_pylist() for n in names])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s, f, m, q, n in columns(batch, "seq", "flag", "mm", "ml", "mn"):
                try:
                    if s is None or m is None:
                        raise tags.TagError("no tags")
                    found = tags.decode(tags.own_direction(s.upper(), bool(f & 16)), m, q or [], n, not f & 0x900)
                    out.append([{"mod_strand": x, "base": b, "fwd_pos": p, "probs": list(v.items())} for (x, b, p), (v, _, _) in sorted(found.items())])
                except tags.TagError:
                    out.append(None)
            yield batch.append_column("_calls", pa.array(out, _ARROW))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s, f, c in columns(batch, "seq", "flag", "_calls"):
                if c:
                    own = tags.own_direction(s.upper(), bool(f & 16))
                    out.append(tags.encode(own, {(k["mod_strand"], k["base"], k["fwd_pos"]): dict(k["probs"]) for k in c}))
                else:
                    out.append((None, None))
            new = pa.array([m for m, _ in out], pa.string()), pa.array([q for _, q in out], pa.list_(pa.int32()))
            done = pa.array([c is not None for c in batch.column("_calls").to_pylist()])
            yield batch.drop_columns("_calls").append_column("_done", done).append_column("_mm", new[0]).append_column("_ml", new[1])

    # whole batches instead of column functions: the planner can't move those into each other
    read = reads.mapInArrow(decode, f"{plain}, _calls {_CALLS}")
    new = read.withColumn("_calls", change(F.col("_calls"))).mapInArrow(encode, f"{plain}, _done boolean, _mm string, _ml array<int>")
    own = {"mm": F.col("_mm"), "ml": F.col("_ml"), "mn": F.when(F.col("_mm").isNotNull(), F.length("seq"))}
    return new.withColumns({c: F.when(F.col("_done"), x).otherwise(F.col(c)) for c, x in own.items()}).drop("_done", "_mm", "_ml")


def _own_base(call: Column) -> Column:
    return F.when(call["mod_strand"] == "-", complement(call["base"])).otherwise(call["base"])


def _with(call: Column, probs: Column) -> Column:
    return F.struct(call["mod_strand"].alias("mod_strand"), call["base"].alias("base"), call["fwd_pos"].alias("fwd_pos"), probs.alias("probs"))


def adjust_reads(reads: DataFrame, ignore: list[str] = (), convert: list[tuple[str, str]] = (), edge: tuple[int, int] | None = None, inverted: bool = False, thresholds: P.Thresholds | None = None) -> DataFrame:
    """As ``calls.adjust``, from tags to tags: conversions, codes taken out, the edge
    filter, the threshold filter."""

    def change(calls: Column) -> Column:
        def one(call: Column) -> Column:
            probs = call["probs"]
            for source, target in convert:
                probs = P.convert(probs, source, target)
            for code in ignore:
                probs = P.ignore(probs, code)
            return _with(call, probs)

        out = F.filter(F.transform(calls, one), lambda c: F.size(c["probs"]) > 0)
        if edge:
            out = F.filter(out, lambda c: P.within_edges(c["fwd_pos"], F.length("seq"), *edge, inverted))
        if thresholds:
            out = F.filter(out, lambda c: P.threshold_call(c["probs"], _own_base(c), thresholds)["kind"].isin("canonical", "modified"))
        return out

    return _rewritten(reads, change)


def call_reads(reads: DataFrame, thresholds: P.Thresholds) -> DataFrame:
    """As ``calls.call_mods``: the called class at probability 1, failed calls left out."""

    def change(calls: Column) -> Column:
        new = F.transform(calls, lambda c: _with(c, P.call_to_probs(c["probs"], P.threshold_call(c["probs"], _own_base(c), thresholds))))
        return F.filter(new, lambda c: c["probs"].isNotNull())

    return _rewritten(reads, change)
