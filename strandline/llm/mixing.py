"""Mixing sources to target weights by Pfair scheduling of equal-sized blocks.

Sizes are tokens of a public tokenizer, counted over whole texts.  Every source gets a
quota of tokens: its target share of the total, but not more than ``max_repeats`` times
what it has; what capped sources leave is shared among the others in proportion to
their targets.  Quotas are cut into blocks of one size; block i of a source of weight w
is released at slot floor(i / w) and due at ceil((i + 1) / w), and earliest deadline
first fills slot after slot.  As the weights add up to 1, no deadline is missed and
after every slot each source is less than one block from its share.

Only source totals (as many as there are targets) and the block schedule (``slots``
entries, whatever the data's size) are on the driver.  Documents find their block by
running token sums, made in hash-range buckets, so no source is summed in one task.

Defined results: documents without a source or with one that has no target are not
mixed and are reported with target share 0; targets without documents are reported with
0 tokens; null texts have 0 tokens; a document given twice is mixed twice as often;
empty tables give an empty mix and a report of the targets.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import math
import os
from collections.abc import Callable, Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import materialize

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern of the byte-level BPE vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_encodings: dict[bytes, object] = {}


def encoding(vocabulary: bytes):
    """The tokenizer of a vocabulary file's contents, made once in a process."""
    key = hashlib.md5(vocabulary).digest()
    if key not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _encodings[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def count_tokens(docs: DataFrame, keep: list[str], text: str = "text", folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of each row.  The vocabulary (about a
    megabyte) is read here and sent to the tasks: executors need no such folder."""
    with open(os.path.join(folder, vocabulary), "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "n_tokens long"])

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(shared.value).encode_ordinary
        for f in frames:
            texts = f.pop("_text")
            f["n_tokens"] = [len(encode(t)) if t else 0 for t in texts]
            yield f

    return docs.select(*keep, F.col(text).alias("_text")).mapInPandas(apply, schema)


def quotas(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: int) -> dict[str, int]:
    """Tokens wanted of each source.  Sources at their cap are fixed, and the rest of
    ``total`` goes to the others by target share, until none exceeds its cap."""
    cap = {s: tokens.get(s, 0) * max(0, r or 0) for s, (_, r) in targets.items()}
    share = {s: Fraction(w).limit_denominator(10**9) for s, (w, _) in targets.items() if w and w > 0 and cap[s] > 0}
    fixed: dict[str, int] = {}
    while share:
        rest, weight = total - sum(fixed.values()), sum(share.values())
        over = [s for s in share if rest * share[s] / weight >= cap[s]]
        if not over:
            return fixed | {s: int(rest * w / weight) for s, w in share.items()}
        for s in over:
            fixed[s] = cap[s]
            del share[s]
    return fixed


def schedule(quota: dict[str, int], slots: int) -> tuple[int, list[tuple[int, str, int]]]:
    """Block size and, for every slot, (slot, source, number of the source's block)."""
    whole = sum(quota.values())
    if whole <= 0:
        return 1, []
    block = max(1, math.ceil(whole / slots))
    plan, free = [], 0
    pending = [(0, s, 0) for s in sorted(quota) if quota[s] > 0]  # (release, source, block)
    heapq.heapify(pending)
    ready: list[tuple[int, str, int]] = []
    while pending or ready:
        while pending and pending[0][0] <= free:
            _, s, i = heapq.heappop(pending)
            heapq.heappush(ready, (-(-(i + 1) * whole // quota[s]), s, i))
        if not ready:  # only where rounding the last blocks up leaves a gap
            free = pending[0][0]
            continue
        _, s, i = heapq.heappop(ready)
        plan.append((len(plan), s, i))
        free += 1
        if (i + 1) * block < quota[s]:
            heapq.heappush(pending, ((i + 1) * whole // quota[s], s, i + 1))
    return block, plan


class Mix:
    """``documents``: one row per use of a document (slot, source, block, repeat, doc_id,
    n_tokens).  ``report()``: one row per source."""

    def __init__(self, documents: DataFrame, report: Callable[[], DataFrame]):
        self.documents, self.report = documents, report


def mix(
    docs: DataFrame,
    targets: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    total_tokens: int | None = None,
    slots: int = 4096,
    buckets: int | None = None,
    salt: str = "strandline/mix/1",
    folder: str = TOKENIZER_DIR,
    vocabulary: str = VOCABULARY,
) -> Mix:
    """Mixes to ``total_tokens`` (default: as many as the sources with a target have).
    Within a source, documents come in the order of a hash of their id, in every repeat.
    A document belongs to the block in which it starts; those starting before the quota
    is full are used, so a source exceeds its quota by less than one document."""
    spark = docs.sparkSession
    renamed = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    sized = materialize(count_tokens(renamed, ["doc_id", "source"], "text", folder, vocabulary))
    want = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.where("source is not null").collect()}
    goal = targets.select("source").where("source is not null").distinct()
    mixed = sized.join(F.broadcast(goal), "source", "left_semi")
    if buckets is None:
        # so that a bucket has about a million documents; the driver gets a sum of each
        buckets = min(65_536, max(1024, sized.count() // 1_000_000))
    place = F.md5(F.concat(F.lit(salt + "/"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    bucket = (F.conv(F.substring(place, 1, 6), 16, 10).cast("long") * buckets / F.lit(16**6)).cast("int")
    mixed = mixed.withColumn("place", place).withColumn("bucket", bucket)
    per_bucket = mixed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("size")).collect()  # targets x buckets rows at most
    have: dict[str, int] = {}
    offsets = []
    for r in sorted(per_bucket, key=lambda r: (r["source"], r["bucket"])):
        offsets.append((r["source"], r["bucket"], have.get(r["source"], 0)))
        have[r["source"]] = have.get(r["source"], 0) + r["size"]
    quota = quotas(have, want, sum(have.values()) if total_tokens is None else total_tokens)
    block, plan = schedule(quota, slots)
    start = spark.createDataFrame(offsets, "source string, bucket int, before long")
    limits = spark.createDataFrame([(s, have[s], q) for s, q in quota.items()], "source string, have long, quota long")
    order = spark.createDataFrame(plan, "slot long, source string, block long")
    w = Window.partitionBy("source", "bucket").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        mixed.withColumn("inside", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))
        .join(F.broadcast(start), ["source", "bucket"])
        .join(F.broadcast(limits), "source")
        .withColumn("first", F.col("before") + F.col("inside"))
        .where("first < quota")
        # repeat r starts at r * have: as many repeats as start before the quota is full
        .withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1 - F.col("first")) / F.col("have")).cast("long"))))
        .withColumn("block", F.floor((F.col("repeat") * F.col("have") + F.col("first")) / F.lit(block)).cast("long"))
    )
    used = placed.join(F.broadcast(order), ["source", "block"]).select("slot", "source", "block", "repeat", "doc_id", "n_tokens")

    def report() -> DataFrame:
        sums = used.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.max("repeat").alias("repeat"), F.count("*").alias("uses"))
        all_ = sized.groupBy("source").agg(F.sum("n_tokens").alias("have_tokens"), F.count("*").alias("documents"))
        known = spark.createDataFrame([(s, float(w or 0), int(r or 0), quota.get(s, 0)) for s, (w, r) in want.items()], "source string, target_share double, max_repeats int, quota_tokens long")
        both = all_.alias("a").join(known.alias("k"), F.col("a.source").eqNullSafe(F.col("k.source")), "full").join(sums.alias("s"), F.coalesce("a.source", "k.source").eqNullSafe(F.col("s.source")), "left")
        n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
        total = F.sum(n("mixed_tokens")).over(Window.partitionBy())  # one row per source
        return both.select(
            F.coalesce("a.source", "k.source").alias("source"),
            F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
            F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"),
            n("documents").alias("documents"),
            n("have_tokens").alias("have_tokens"),
            n("quota_tokens").alias("quota_tokens"),
            n("mixed_tokens").alias("mixed_tokens"),
            n("uses").alias("uses"),
            (F.coalesce(F.col("repeat"), F.lit(-1)) + 1).cast("int").alias("times_used"),
            F.coalesce(F.try_divide(n("mixed_tokens").cast("double"), total.cast("double")), F.lit(0.0)).alias("actual_share"),
            F.coalesce(n("quota_tokens") >= n("have_tokens") * F.col("max_repeats"), F.lit(False)).alias("capped"),
        )

    return Mix(used, report)
