"""Order statistics of very large groups by distributed multi-select.

Rows are first summed by (group, value), which combines on the map side and spreads a
hot group over all tasks by its values; the sums are written once and then only read.

Of each range of a group that holds a wanted rank only the bounds are kept.  In a round
every partition proposes its weighted median of each range, and those of the halves, and
so on (``DEPTH`` deep); the weighted medians of the partitions' proposals become the
pivots; one more pass counts the values between and at the pivots; ranks at a pivot are
found, the others go to the part they fall in, and all other parts are discarded.  A
pivot is a value of the range, so every round shortens each range and the rounds end
when all ranks are found.

Bounds, pivots and counts of at most ``AT_ONCE`` wanted ranks are on the driver and with
the tasks; more groups are handled in slices, one after the other, so that this does not
grow with the number of groups.  Nothing is shuffled in a round but proposals and counts.

The operators are exact (rank error 0); ``summaries`` and ``combine`` give results of
parts that add up, with a stated bound of rank error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import materialize, release, usable

#: A range is split by 2^DEPTH - 1 pivots a round.
DEPTH = 5
#: Wanted ranks that are looked for at a time.
AT_ONCE = 200_000


def value_counts(rows: DataFrame, keys: list[str], value: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """(keys, v, c): how often each usable value occurs in each group."""
    v = F.col(value).cast("double")
    return rows.where(usable(F.col(value), low, high)).groupBy(*keys, (v + F.lit(0.0)).alias("v")).agg(F.count("*").alias("c"))


def key_text(keys: list[str], level: str = "") -> Column:
    """A string that is the same for the same keys of a level, nulls included."""
    return F.to_json(F.struct(F.lit(level).alias("l"), *[F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(keys)]))


class Cuts:
    """Values at which the ranges of groups are cut, by group and value.  ``gap`` holds a
    number for the values between a cut and the one before it, or -1 where they are of no
    interest; ``names`` numbers the groups."""

    def __init__(self, names: dict[str, int], group: np.ndarray, value: np.ndarray, gap: np.ndarray):
        by = np.lexsort((value, group))
        self.names, self.group, self.value, self.gap = names, group[by], value[by], gap[by]
        self.levels = np.unique(self.value)
        self.keys = self._key(self.group, np.searchsorted(self.levels, self.value), np.ones(len(by), np.int64))

    def _key(self, group: np.ndarray, rank: np.ndarray, same: np.ndarray) -> np.ndarray:
        return group * (2 * len(self.levels) + 2) + 2 * rank + same

    def locate(self, k: pd.Series, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known group, number of the cut at or after the value, whether at it)."""
        code, names = pd.factorize(k)
        group = np.array([self.names.get(n, -1) for n in names], np.int64)[code] if len(names) else np.zeros(0, np.int64)
        rank = np.searchsorted(self.levels, v)
        same = self.levels[np.minimum(rank, len(self.levels) - 1)] == v if len(self.levels) else np.zeros(len(v), bool)
        key = self._key(group, rank, same.astype(np.int64))
        at = np.searchsorted(self.keys, key)
        inside = np.minimum(at, max(0, len(self.keys) - 1))
        known = (group >= 0) & (at < len(self.keys))
        known &= self.group[inside] == group if len(self.keys) else False
        return known, inside, known & (self.keys[inside] == key if len(self.keys) else False)


def local_medians(range_: np.ndarray, v: np.ndarray, c: np.ndarray, depth: int) -> pd.DataFrame:
    """For each range the values at the shares 1/2, 1/4, 3/4, ... of its weight, in order."""
    by = np.lexsort((v, range_))
    range_, v, c = range_[by], v[by], c[by]
    start = np.flatnonzero(np.r_[True, range_[1:] != range_[:-1]])
    total = np.add.reduceat(c, start)
    base = np.cumsum(total) - total
    parts = 1 << depth
    # the least value that at least a share j / parts is not above
    want = base[:, None] + np.maximum(1, -(-total[:, None] * np.arange(1, parts) // parts))
    at = np.searchsorted(np.cumsum(c), want)
    return pd.DataFrame({"range": range_[start], "w": total, "v": list(v[at])})


def _concat(frames: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(frames, ignore_index=True) if len(frames) != 1 else frames[0]


def _over(counts: DataFrame, groups: list[str], cuts: Cuts, what: Callable, schema: str) -> DataFrame:
    """``what`` is given, for each partition and level, where its values lie among the cuts."""
    shared = counts.sparkSession.sparkContext.broadcast(cuts)

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[list[np.ndarray]] = []
        for f in frames:
            v, c = f["v"].to_numpy(np.float64), f["c"].to_numpy(np.int64)
            for k in groups:
                known, at, same = shared.value.locate(f[k], v)
                kept = known & (same | (shared.value.gap[at] >= 0)) if len(at) else known
                parts.append([at[kept], same[kept], v[kept], c[kept]])
        if parts:
            at, same, v, c = (np.concatenate(x) for x in zip(*parts))
            if len(at):
                yield what(shared.value, at, same, v, c)

    return counts.select(*groups, "v", "c").mapInPandas(apply, schema)


def _pandas(df: DataFrame) -> pd.DataFrame:
    return df.toArrow().to_pandas()


def _pivots(counts: DataFrame, groups: list[str], cuts: Cuts, depth: int) -> pd.DataFrame:
    """(range, p): the pivots of each range, in order."""

    def propose(cuts: Cuts, at, same, v, c) -> pd.DataFrame:
        inner = ~same
        return local_medians(cuts.gap[at[inner]], v[inner], c[inner], depth) if inner.any() else pd.DataFrame({"range": [], "w": [], "v": []}).astype({"range": "int64", "w": "int64", "v": object})

    def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [f for f in frames if len(f)]
        if own:
            f = _concat(own)
            v = np.stack(f["v"].to_numpy())
            many = v.shape[1]
            range_, w = np.repeat(f["range"].to_numpy() * many, many) + np.tile(np.arange(many), len(f)), np.repeat(f["w"].to_numpy(), many)
            middle = local_medians(range_, v.ravel(), w, 1)
            yield pd.DataFrame({"range": middle["range"] // many, "p": [x[0] for x in middle["v"]]}).drop_duplicates()

    proposed = _over(counts, groups, cuts, propose, "range long, w long, v array<double>")
    return _pandas(proposed.repartition("range").mapInPandas(settle, "range long, p double"))


def _tally(counts: DataFrame, groups: list[str], cuts: Cuts) -> np.ndarray:
    """Rows in the gap before each cut (even places) and at it (odd places)."""

    def count(cuts: Cuts, at, same, v, c) -> pd.DataFrame:
        n = np.bincount(2 * at + same, c, 2 * len(cuts.keys))
        place = np.flatnonzero(n)
        return pd.DataFrame({"place": place, "n": n[place].astype(np.int64)})

    got = _pandas(_over(counts, groups, cuts, count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")))
    out = np.zeros(2 * len(cuts.keys), np.int64)
    out[got["place"].to_numpy()] = got["n"].to_numpy()
    return out


def multiselect(counts: DataFrame, groups: list[str], targets: pd.DataFrame, depth: int = DEPTH) -> pd.DataFrame:
    """``counts``: (v, c) and for each grouping level a column that names the row's group
    (names differ between levels).  ``targets``: (k, rank), ranks from 1 to the sum of c
    of the group.  Returns (k, rank, value, below, equal): the value at that rank, and how
    many of the group are below it and equal to it."""
    targets = targets[["k", "rank"]].drop_duplicates().sort_values(["k", "rank"]).reset_index(drop=True)
    code, known = pd.factorize(targets["k"])
    names = {n: i for i, n in enumerate(known)}
    rank = targets["rank"].to_numpy(np.int64)
    value, below, equal = np.full(len(rank), np.nan), np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
    # the range of each wanted rank: open bounds, and the rows of the group below it
    low, high, base = np.full(len(rank), -np.inf), np.full(len(rank), np.inf), np.zeros(len(rank), np.int64)
    open_ = np.arange(len(rank))
    while len(open_):
        g = code[open_].astype(np.int64)
        first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (low[open_][1:] != low[open_][:-1])])
        range_ = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(open_)]))
        rg, rl, rh = g[first], low[open_][first], high[open_][first]
        # a range's lower bound closes the gap before it; its own gap lies before its upper bound
        bounded = np.isfinite(rl) & ~((np.r_[-1, rg[:-1]] == rg) & (np.r_[-np.inf, rh[:-1]] == rl))
        edge = lambda p_range, p: Cuts(
            names,
            np.concatenate([rg[bounded], rg, rg[p_range]]),
            np.concatenate([rl[bounded], rh, p]),
            np.concatenate([np.full(bounded.sum(), -1), np.arange(len(rg)), p_range]),
        )
        pivots = _pivots(counts, groups, edge(np.zeros(0, np.int64), np.zeros(0)), depth)
        p_range = pivots["range"].to_numpy(np.int64)
        if len(np.unique(p_range)) < len(rg):
            raise ValueError("a wanted rank is not between 1 and the number of the group's rows")
        cuts = edge(p_range, pivots["p"].to_numpy(np.float64))
        n = _tally(counts, groups, cuts)
        # cuts of a range in order: its pivots, then its upper bound
        own = np.flatnonzero(cuts.gap >= 0)
        of = cuts.gap[own]
        upto = np.cumsum(n.reshape(-1, 2)[own].ravel())  # at the end of each gap and each cut
        start = np.searchsorted(of, np.arange(len(rg)))
        zero = np.r_[0, upto][2 * start]
        want = zero[range_] + rank[open_] - base[open_]
        spot = np.searchsorted(upto, want)
        at, hit = own[spot // 2], spot % 2 == 1
        before = np.r_[0, upto][spot] - zero[range_] + base[open_]
        done = open_[hit]
        value[done], below[done], equal[done] = cuts.value[at[hit]], before[hit], n[2 * at[hit] + 1]
        rest = open_[~hit]
        at, lowest = at[~hit], spot[~hit] // 2 == start[range_[~hit]]
        low[rest] = np.where(lowest, low[rest], cuts.value[at - 1])
        high[rest], base[rest] = cuts.value[at], before[~hit]
        open_ = rest
    return targets.assign(value=value, below=below, equal=equal)


def next_values(counts: DataFrame, groups: list[str], found: pd.DataFrame) -> pd.Series:
    """The least value of the group above each found one (k, value); NaN if there is none."""
    each = found[["k", "value"]].drop_duplicates()
    names = {k: i for i, k in enumerate(pd.unique(each["k"]))}
    own = each["k"].map(names).to_numpy(np.int64)
    whole = np.arange(len(names), dtype=np.int64)
    cuts = Cuts(names, np.r_[own, whole], np.r_[each["value"].to_numpy(np.float64), np.full(len(whole), np.inf)], np.zeros(len(own) + len(whole), np.int64))

    def least(cuts: Cuts, at, same, v, c) -> pd.DataFrame:
        return pd.DataFrame({"at": at[~same], "v": v[~same]}).groupby("at", as_index=False)["v"].min()

    got = _pandas(_over(counts, groups, cuts, least, "at long, v double").groupBy("at").agg(F.min("v").alias("v")))
    gap = np.full(len(cuts.keys), np.nan)
    gap[got["at"].to_numpy()] = got["v"].to_numpy()
    above = np.where(np.isnan(gap), np.where(np.isinf(cuts.value), np.nan, cuts.value), gap)[1:]
    text = list(names)
    known = {(text[g], v): x for g, v, x in zip(cuts.group[:-1].tolist(), cuts.value[:-1].tolist(), above.tolist()) if np.isfinite(v)}
    return pd.Series([known[k, v] for k, v in zip(found["k"], found["value"])], index=found.index, dtype=float)


def _in_slices(groups: DataFrame, per_group: int, find: Callable[[pd.DataFrame], pd.DataFrame], schema: str, at_once: int = AT_ONCE) -> DataFrame:
    """Calls ``find`` with the rows of ``groups`` (k and more) and a condition on ``k``,
    so many groups at a time that about ``at_once`` ranks are wanted; results are put together."""
    spark = groups.sparkSession
    n = groups.count()
    slices = max(1, -(-n * per_group // at_once))
    out = None
    for s in range(slices):
        mine = f"pmod(xxhash64(k), {slices}) = {s}" if slices > 1 else "true"
        got = find(_pandas(groups.where(mine)))
        part = spark.createDataFrame(pa.Table.from_pandas(got, preserve_index=False), schema) if len(got) else spark.createDataFrame([], schema)
        part = materialize(part) if slices > 1 else part
        out = part if out is None else out.unionByName(part)
    return out


def _ranks(n: np.ndarray, shares: np.ndarray) -> np.ndarray:
    # 1e-9: 0.1 * 30 is a little over 3
    return np.maximum(1, np.ceil(shares * n - 1e-9)).astype(np.int64)


def percentiles(rows: DataFrame, keys: list[str], value: str, qs: list[float], levels: dict[str, list[str]] | None = None, low: float | None = None, high: float | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """For each grouping level and group, ``n`` usable values and for each q the value at
    rank ceil(q n) (at least 1): the smallest value that at least a share q is not above.
    ``rank_error`` is 0.  Levels share the sums of the finest grouping.

    Null, NaN, infinite and out-of-range values are left out; a group without usable
    values has no row; null keys form groups of their own; ties give the tied value;
    repeated rows count as often as they occur; an empty table gives no rows."""
    levels = levels or {"all": keys}
    names = [f"k{i}" for i in range(len(levels))]
    counts = value_counts(rows, keys, value, low, high)
    counts = materialize(counts.select(*keys, *[key_text(own, level).alias(k) for k, (level, own) in zip(names, levels.items())], "v", "c"))
    kind = {c: rows.schema[c].dataType for c in keys}
    fine = counts.groupBy(*keys, *names).agg(F.sum("c").alias("n"))
    per_level = [F.struct(F.col(k).alias("k"), F.lit(level).alias("level"), *[(F.col(c) if c in own else F.lit(None).cast(kind[c])).alias(c) for c in keys]) for k, (level, own) in zip(names, levels.items())]
    groups = materialize(fine.select(F.explode(F.array(*per_level)).alias("g"), "n").groupBy("g.k", "g.level", *[f"g.{c}" for c in keys]).agg(F.sum("n").alias("n")))

    def find(own: pd.DataFrame) -> pd.DataFrame:
        q = np.tile(np.array(qs, float), len(own))
        each = own[["k", "n"]].loc[own.index.repeat(len(qs))].reset_index(drop=True).assign(q=q)
        each["rank"] = _ranks(each["n"].to_numpy(), q)
        got = multiselect(counts, names, each)
        return each.merge(got, on=["k", "rank"])[["k", "q", "rank", "value"]]

    found = _in_slices(groups.select("k", "n"), len(qs), find, "k string, q double, rank long, value double", at_once)
    out = materialize(groups.join(found, "k").select("level", *keys, "n", "q", "rank", "value", F.lit(0).cast("long").alias("rank_error")))
    for t in (counts, groups):
        release(t)
    return out


def summaries(rows: DataFrame, keys: list[str], value: str, points: int = 64, low: float | None = None, high: float | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """A mergeable summary of each group: the exact values at ranks ceil(i n / points),
    i = 0 .. points, each with the rows since the point before (``weight``)."""
    counts = materialize(value_counts(rows, keys, value, low, high).select(*keys, key_text(keys).alias("k"), "v", "c"))
    groups = materialize(counts.groupBy("k", *keys).agg(F.sum("c").alias("n")))

    def find(own: pd.DataFrame) -> pd.DataFrame:
        i = np.tile(np.arange(points + 1), len(own))
        each = own[["k", "n"]].loc[own.index.repeat(points + 1)].reset_index(drop=True)
        each["rank"] = _ranks(i * each["n"].to_numpy() / points, np.ones(len(i)))
        each = each.drop_duplicates(["k", "rank"])
        got = each.merge(multiselect(counts, ["k"], each), on=["k", "rank"]).sort_values(["k", "rank"])
        got["weight"] = got["rank"] - got.groupby("k")["rank"].shift(fill_value=0)
        return got[["k", "rank", "value", "weight"]]

    found = _in_slices(groups.select("k", "n"), points + 1, find, "k string, rank long, value double, weight long", at_once)
    out = materialize(groups.join(found, "k").select(*keys, "n", "rank", "value", "weight"))
    for t in (counts, groups):
        release(t)
    return out


def combine(summary: DataFrame, keys: list[str], qs: list[float], part: list[str]) -> DataFrame:
    """Percentiles of groups ``keys`` from the summaries of their parts (columns ``part``).

    ``rank_error``: the value's rank differs from the wanted one by at most this many
    rows, the sum over the parts of their widest gap between points (about n / points)."""
    own = summary.groupBy(*keys, *part).agg(F.max("n").alias("n"), (F.max("weight") - 1).alias("gap"))
    total = own.groupBy(*keys).agg(F.sum("n").alias("n"), F.greatest(F.sum("gap"), F.lit(0)).cast("long").alias("rank_error"), F.count("*").alias("parts"))
    w = Window.partitionBy(*keys).orderBy("value")
    points = summary.groupBy(*keys, "value").agg(F.sum("weight").alias("weight")).withColumn("upto", F.sum("weight").over(w))
    same = _same(keys)
    wanted = _targets(total, qs)
    hit = wanted.alias("t").join(points.alias("p"), same).where("p.upto >= t.rank")
    return hit.groupBy(*[F.col(f"t.{c}").alias(c) for c in keys], "t.n", "t.q", "t.rank", "t.rank_error", "t.parts").agg(F.min("p.value").alias("value")).select(*keys, "parts", "n", "q", "rank", "value", "rank_error")


def _targets(groups: DataFrame, qs: list[float]) -> DataFrame:
    q = F.explode(F.array(*[F.lit(float(x)) for x in qs]))
    return groups.withColumn("q", q).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n") - 1e-9)).cast("long"))


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for c in keys:
        out &= F.col(f"t.{c}").eqNullSafe(F.col(f"p.{c}"))
    return out


def cutoffs(rows: DataFrame, targets: DataFrame, keys: list[str], score: str, fraction: str = "keep_fraction", low: float | None = None, high: float | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """For each target its cutoff: rows with ``score >= cutoff`` are kept, and their share
    of the group's usable rows is as close to the wanted fraction as ties allow (of two
    equally close cutoffs the one that keeps more).

    ``cutoff`` is null where nothing is kept or the group has no usable row.
    ``n_unusable``: rows whose score is null, NaN, infinite or out of range; they are
    neither kept nor dropped.  Groups without a target are left out; null keys match no
    target; a target given twice gives two rows."""
    wanted = targets.select(*keys, F.col(fraction).cast("double").alias("keep_fraction"))
    usable_ = usable(F.col(score), low, high)
    named = wanted.select(*keys).where(" and ".join(f"{c} is not null" for c in keys)).distinct()
    own = rows.select(*keys, F.when(usable_, F.col(score).cast("double") + F.lit(0.0)).alias("v")).join(named, keys)
    counts = materialize(own.groupBy(*keys, "v").agg(F.count("*").alias("c")).select(*keys, key_text(keys).alias("k"), "v", "c"))
    size = lambda c: F.coalesce(F.sum(F.when(c, F.col("c"))), F.lit(0))
    groups = counts.groupBy("k", *keys).agg(size(F.col("v").isNotNull()).alias("n"), size(F.col("v").isNull()).alias("n_unusable"))
    values = counts.where("v is not null")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    goals = materialize(wanted.join(groups, keys, "left").select(key_text([*keys, "keep_fraction"]).alias("goal_key"), "*").withColumn("n", n(F.col("n"))).withColumn("n_unusable", n(F.col("n_unusable"))))

    def find(each: pd.DataFrame) -> pd.DataFrame:
        each = each.drop_duplicates(["goal", "k"]).copy()
        goal, whole = each["keep_fraction"].to_numpy() * each["n"].to_numpy(), each["n"].to_numpy()
        each["rank"] = np.clip(whole - np.ceil(goal - 1e-9) + 1, 1, whole).astype(np.int64)
        got = each.merge(multiselect(values, ["k"], each), on=["k", "rank"])
        goal, whole = got["keep_fraction"].to_numpy() * got["n"].to_numpy(), got["n"].to_numpy()
        with_, without = whole - got["below"].to_numpy(), whole - (got["below"] + got["equal"]).to_numpy()
        more = np.abs(with_ - goal) <= np.abs(without - goal) + 1e-9
        # of a tied value and the next higher one, the one whose share comes closer
        got["cutoff"] = np.where(more, got["value"], next_values(values, ["k"], got))
        got["n_kept"] = np.where(more, with_, without)
        return got[["goal", "cutoff", "n_kept"]]

    asked = goals.where("n > 0 and keep_fraction is not null").select("k", F.col("goal_key").alias("goal"), "keep_fraction", "n")
    found = _in_slices(asked, 1, find, "goal string, cutoff double, n_kept long", at_once)
    kept = n(F.col("n_kept"))
    out = goals.join(found, F.col("goal_key") == F.col("goal"), "left").select(
        *keys,
        "keep_fraction",
        "cutoff",
        "n",
        kept.alias("n_kept"),
        (F.col("n") - kept).alias("n_dropped"),
        "n_unusable",
        F.try_divide(kept.cast("double"), F.col("n").cast("double")).alias("kept_share"),
    )
    out = materialize(out)
    for t in (counts, goals):
        release(t)
    return out
