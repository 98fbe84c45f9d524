"""Differential modification between samples: positions, sites, regions, pairs, segments."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import stats
from strandline.operators.intervals import points_in
from strandline.operators.tables import plain_code
from strandline.schema import base_of_code
from strandline.session import materialize

POSITION = ("chrom", "chromstart", "strand")


def best_rows(bed: DataFrame, by: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """Of rows delivered repeatedly for one key the one with most coverage, then most
    modified counts; rows without a key are left out."""
    rows = plain_code(bed).where("chrom is not null and chromstart is not null and strand is not null and name is not null and valid_coverage is not null")
    best = F.max(F.struct("valid_coverage", "count_modified", "count_canonical"))
    return rows.groupBy(*by, *POSITION, "code").agg(best.alias("b")).select(*by, *POSITION, "code", "b.*")


def position_counts(rows: DataFrame, by: tuple[str, ...] = ("sample_id",), min_coverage: int = 0) -> DataFrame:
    """Counts of each position: ``counts`` (code to modified reads) and ``total``.

    Positions whose modified counts exceed the coverage contradict themselves and are
    left out (``contradictions`` has them), as are codes of no known base and positions
    below ``min_coverage``."""
    known = rows.where(base_of_code(F.col("code")).isNotNull())
    out = known.groupBy(*by, *POSITION).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "count_modified")))).alias("counts"), F.max("valid_coverage").alias("total"), F.sum("count_modified").alias("n_mod"))
    return out.where((F.col("n_mod") <= F.col("total")) & (F.col("total") >= min_coverage))


def contradictions(rows: DataFrame, by: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """Positions whose codes disagree about the coverage, or modify more reads than it has."""
    known = rows.where(base_of_code(F.col("code")).isNotNull())
    out = known.groupBy(*by, *POSITION).agg(F.min("valid_coverage").alias("least_coverage"), F.max("valid_coverage").alias("most_coverage"), F.sum("count_modified").alias("n_mod"))
    return out.where("least_coverage <> most_coverage or n_mod > most_coverage")


def pool(counts: DataFrame, keys: list[str], balanced: bool = False) -> DataFrame:
    """Counts of replicates put together.  ``balanced``: every replicate enters with the
    mean coverage, its code counts scaled to that and rounded down."""
    if balanced:
        mean = F.avg("total").over(Window.partitionBy(*keys))
        # fractions and means as single-precision numbers, as is usual for them
        counts = counts.withColumn("_mean", mean.cast("float"))
        scaled = F.transform_values("counts", lambda _, v: F.floor(v.cast("float") / F.col("total").cast("float") * F.col("_mean")).cast("long"))
        replicates = F.count("*").over(Window.partitionBy(*keys)) > 1
        counts = counts.withColumn("counts", F.when(replicates, scaled).otherwise(F.col("counts"))).withColumn("total", F.when(replicates, F.floor("_mean").cast("long")).otherwise(F.col("total")))
    flat = counts.select(*keys, "total", F.explode_outer("counts").alias("code", "n"))
    totals = counts.groupBy(*keys).agg(F.sum("total").alias("total"))
    by_code = flat.where("code is not null").groupBy(*keys, "code").agg(F.sum("n").alias("n"))
    maps = by_code.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("counts"), F.sum("n").alias("n_mod"))
    return totals.join(maps, keys, "left").withColumn("counts", F.coalesce("counts", F.create_map().cast("map<string,bigint>"))).withColumn("n_mod", F.coalesce("n_mod", F.lit(0)))


def llr(a: str, na: str, b: str, nb: str) -> Column:
    """Score of two columns of count maps with their totals: 0 without codes, the beta
    score with one code, Dirichlet with more; null where each sample has one code and they
    differ (two categories, of which the beta score allows one)."""
    codes = f"array_sort(array_union(map_keys({a}), map_keys({b})))"
    whole = lambda m: f"aggregate(map_values({m}), 0L, (s, x) -> s + x)"
    classes = lambda m, n: f"array_append(transform(codes, c -> cast(coalesce(try_element_at({m}, c), 0L) as double)), cast({n} - {whole(m)} as double))"
    dirichlet = stats.let(f"named_struct('p', {classes(a, na)}, 'q', {classes(b, nb)})", "m", stats.llr_dirichlet_sql("m.p", "m.q"))
    beta = stats.let(f"named_struct('k', {whole(a)}, 'l', {whole(b)})", "m", stats.llr_beta_sql("m.k", na, "m.l", nb))
    n = f"greatest(size({a}), size({b}))"
    return F.expr(stats.let(codes, "codes", f"case when {n} < 1 then 0D when {n} = 1 then case when size(codes) = 1 then {beta} end else {dirichlet} end"))


def counts_text(m: Column) -> Column:
    """``a:1,b:2``, sorted by code; ``.`` without codes."""
    items = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return F.when(F.size(m) == 0, ".").otherwise(F.array_join(items, ","))


def sites(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positions that both pooled samples cover, with score and effect size (a − b)."""
    left = a.select(*POSITION, F.col("counts").alias("a_counts"), F.col("total").alias("a_total"), F.col("n_mod").alias("a_mod"))
    right = b.select(*POSITION, F.col("counts").alias("b_counts"), F.col("total").alias("b_total"), F.col("n_mod").alias("b_mod"))
    both = left.join(right, list(POSITION)).where("a_total > 0 and b_total > 0")
    score = llr("a_counts", "a_total", "b_counts", "b_total")
    return both.withColumn("score", score).withColumn("effect_size", F.col("a_mod") / F.col("a_total") - F.col("b_mod") / F.col("b_total"))


def coverage_cap(counts: DataFrame, q: float = 0.95, replicates: int = 1, capped: bool = False, ceiling: int = 300) -> int:
    """The coverage up to which counts are believed: a percentile, rounded down, times the
    number of replicates unless their counts were ``capped`` before; from 1 to ``ceiling``."""
    by = counts.groupBy("total").agg(F.count("*").alias("c"))
    row = by.agg(F.percentile("total", F.lit(q), F.col("c")).alias("v")).first()
    return min(ceiling, max(1, int(row["v"] or 1) * (1 if capped else replicates)))


def with_p_values(scored: DataFrame, cap_a: int, cap_b: int, delta: float = 0.05) -> DataFrame:
    @F.pandas_udf("p double, effect double")
    def run(ka: pd.Series, na: pd.Series, kb: pd.Series, nb: pd.Series) -> pd.DataFrame:
        p, e = stats.map_p_value(ka, na, kb, nb, cap_a, cap_b, delta=delta)
        return pd.DataFrame({"p": p, "effect": e})

    out = scored.withColumn("_p", run("a_mod", "a_total", "b_mod", "b_total"))
    return out.withColumn("map_p_value", F.col("_p.p")).withColumn("capped_effect_size", F.col("_p.effect")).drop("_p")


def region_counts(counts: DataFrame, regions: DataFrame, by: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """Counts of each region: those of the positions inside, of its strand, added up."""
    hit = points_in(counts.select(*by, *POSITION, "counts", "total"), regions.select("chrom", "start", "end", "region_name", "strand", F.col("strand").alias("region_strand")), "chromstart", "inner", "strand")
    keys = [*by, "chrom", "start", "end", "region_name", "region_strand"]
    # codes first, so that a region's many positions combine on the map side
    by_code = hit.select(*keys, F.explode("counts").alias("code", "n")).groupBy(*keys, "code").agg(F.sum("n").alias("n"))
    maps = by_code.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("counts"), F.sum("n").alias("n_mod"))
    totals = hit.groupBy(*keys).agg(F.sum("total").alias("total"))
    return totals.join(maps, keys)


def region_pairs(counts: DataFrame, pairs: list[tuple[str, str]] | None = None, sample: str = "sample_id") -> DataFrame:
    """Region scores of sample pairs, by default all pairs in sorted order.  A region
    that one of the samples does not cover is left out."""
    keys = ["chrom", "start", "end", "region_name", "region_strand"]
    side = lambda x: counts.select(F.col(sample).alias(f"sample_{x}"), *keys, F.col("counts").alias(f"{x}_counts"), F.col("total").alias(f"{x}_total"), F.col("n_mod").alias(f"{x}_mod"))
    if pairs is None:
        both = side("a").join(side("b"), keys).where("sample_a < sample_b")
    else:
        # the wanted pairs go to one side first, so that no other pair is ever joined
        wanted = counts.sparkSession.createDataFrame(pairs, "sample_a string, sample_b string")
        both = side("a").join(F.broadcast(wanted), "sample_a").join(side("b"), [*keys, "sample_b"])
    score = llr("a_counts", "a_total", "b_counts", "b_total")
    percent = lambda x: F.col(f"{x}_mod") / F.col(f"{x}_total")
    return both.where("a_total > 0 and b_total > 0").select(
        "sample_a", "sample_b", *keys, score.alias("score"), counts_text(F.col("a_counts")).alias("a_counts"), "a_total", counts_text(F.col("b_counts")).alias("b_counts"), "b_total", percent("a").alias("a_pct_modified"), percent("b").alias("b_pct_modified")
    )


def sample_pairs(names: list[str]) -> list[tuple[str, str]]:
    return list(itertools.combinations(sorted(set(names)), 2))


# ---------------------------------------------------------------- segmentation


class Segmenter:
    """Two-state segmentation (same, different) by the best path of a hidden Markov model.

    Viterbi's recursion is a product of 2 x 2 matrices in (max, +), so it is cut into
    blocks of ``block`` bases: every block is multiplied out on its own; the few block
    matrices of a chromosome are chained to fix the states at block borders; every block
    then finds its own best path between fixed borders.  No chromosome is handled in one
    task, however many sites it has.  A gap of ``max_gap`` or more ends a chain; the last
    site of a chain belongs to no segment."""

    def __init__(self, max_gap: int = 5000, prior: float = 0.1, stay: float = 0.9, significance: float = 0.01, decay: int = 500, linear: bool = True, same_factor: float = 0.3, different_factor: float = -0.1, block: int = 1_000_000):
        if stay <= prior:
            raise ValueError("the probability to stay must exceed the prior")
        self.max_gap, self.prior, self.block = max_gap, prior, block
        self.low, self.span, self.decay, self.linear = 1 - stay, stay - prior, float(decay), linear
        self.factors = (same_factor, different_factor)
        self.significance = float(np.log(significance / (1 - significance)))

    def stay(self, gap: np.ndarray) -> np.ndarray:
        """Probability to stay different over a gap."""
        g = np.minimum(gap, self.decay)
        if self.linear:
            part = (g - 2) / (self.decay - 2)
        else:
            part = np.where(gap == 1, 0, (np.log(g) - np.log(2)) / (np.log(self.decay) - np.log(2)))
        return 1 - (part * self.span + self.low)

    def emissions(self, score: np.ndarray) -> np.ndarray:
        p = np.exp(-np.maximum(score, 0))
        p = np.where(p == 0, 1e-5, p)
        return np.stack([self.factors[0] * (np.log(p) - self.significance), self.factors[1] * (np.log(1 - p + 1e-5) - self.significance)], 1)

    def steps(self, gaps: np.ndarray, score: np.ndarray) -> np.ndarray:
        """steps[i][from, to]: from the site before i to site i, its emission included."""
        d = self.stay(gaps)
        m = np.empty((len(score), 2, 2))
        m[:, 0, 0], m[:, 0, 1] = np.log(1 - self.prior), np.log(self.prior)
        m[:, 1, 0], m[:, 1, 1] = np.log(1 - d), np.log(d)
        return m + self.emissions(score)[:, None, :]

    @staticmethod
    def product(m: np.ndarray) -> np.ndarray:
        """Max-plus product of a chain of matrices, by halves."""
        while len(m) > 1:
            half = m[: len(m) // 2 * 2].reshape(-1, 2, 2, 2)
            both = (half[:, 0, :, :, None] + half[:, 1, None, :, :]).max(2)
            m = np.concatenate([both, m[-1:]]) if len(m) % 2 else both
        return m[0]

    def start(self, score: float) -> np.ndarray:
        """Scores of the two states at the first site of a chain."""
        first = np.array([np.log(1 - self.prior), np.log(self.prior)])
        d = self.prior
        t = np.array([[np.log(1 - self.prior), np.log(self.prior)], [np.log(1 - d), np.log(d)]])
        return (first[:, None] + t).max(0) + self.emissions(np.array([score]))[0]

    def path(self, gaps: np.ndarray, score: np.ndarray, entry: np.ndarray, last: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Best states of a run of sites from the scores of its first site; ``last`` fixes the last state."""
        m = self.steps(gaps[1:], score[1:])
        v, back = entry, np.zeros((len(m), 2), int)
        for i, step in enumerate(m):
            through = v[:, None] + step
            back[i] = through.argmax(0)
            v = through.max(0)
        at = int(v.argmax()) if last is None else last
        out = np.empty(len(score), int)
        out[-1] = at
        for i in range(len(m) - 1, -1, -1):
            at = out[i] = back[i, at]
        return out, v

    def segment(self, scored: DataFrame) -> DataFrame:
        """``scored``: chrom, chromstart, score (unique positions; null scores are left
        out).  Returns (chrom, start, end, state, num_sites) in bases, half-open."""
        rows = scored.where("score is not null").select("chrom", F.col("chromstart").alias("pos"), "score").withColumn("block", F.expr(f"pos div {self.block}"))
        rows = materialize(rows)
        seg = self

        def chains(f: pd.DataFrame) -> list[pd.DataFrame]:
            f = f.sort_values("pos")
            cut = np.flatnonzero(np.diff(f["pos"].to_numpy()) >= seg.max_gap) + 1
            return [f.iloc[a:b] for a, b in zip([0, *cut], [*cut, len(f)])]

        def reduce(f: pd.DataFrame) -> pd.DataFrame:
            out = []
            for part, c in enumerate(chains(f)):
                pos, score = c["pos"].to_numpy(), c["score"].to_numpy()
                gaps = np.diff(pos, prepend=pos[0])
                m = seg.product(seg.steps(gaps[1:].astype(float), score[1:])) if len(c) > 1 else np.array([[0, -np.inf], [-np.inf, 0]])
                out.append((c["chrom"].iloc[0], c["block"].iloc[0], part, pos[0], pos[-1], score[0], *m.ravel()))
            return pd.DataFrame(out, columns="chrom block part first last score m00 m01 m10 m11".split())

        blocks = rows.groupBy("chrom", "block").applyInPandas(reduce, "chrom string, block long, part int, first long, last long, score double, m00 double, m01 double, m10 double, m11 double")

        def chain(f: pd.DataFrame) -> pd.DataFrame:
            """Fixes, for each piece, the scores at its first site and the state at its last."""
            f = f.sort_values(["first"]).reset_index(drop=True)
            n = len(f)
            entry, leave, new = np.empty((n, 2)), [None] * n, np.zeros(n, bool)
            inner = f[["m00", "m01", "m10", "m11"]].to_numpy().reshape(-1, 2, 2)
            for i in range(n):
                gap = f["first"][i] - f["last"][i - 1] if i else seg.max_gap
                new[i] = gap >= seg.max_gap
                if new[i]:
                    entry[i] = seg.start(f["score"][i])
                else:
                    entry[i] = (leave[i - 1][:, None] + seg.steps(np.array([float(gap)]), np.array([f["score"][i]]))[0]).max(0)
                leave[i] = (entry[i][:, None] + inner[i]).max(0)
            state = np.zeros(n, int)
            for i in range(n - 1, -1, -1):
                if i == n - 1 or new[i + 1]:
                    state[i] = int(leave[i].argmax())
                else:
                    # the state at the next piece's first site, and before it at this one's last
                    first = int((entry[i + 1] + inner[i + 1][:, state[i + 1]]).argmax())
                    gap = float(f["first"][i + 1] - f["last"][i])
                    state[i] = int((leave[i] + seg.steps(np.array([gap]), np.array([f["score"][i + 1]]))[0][:, first]).argmax())
            ends = np.r_[new[1:], True]
            return pd.DataFrame({"chrom": f["chrom"], "block": f["block"], "part": f["part"], "e0": entry[:, 0], "e1": entry[:, 1], "state": state.astype(np.int32), "chain": np.cumsum(new), "ends": ends})

        fixed = blocks.groupBy("chrom").applyInPandas(chain, "chrom string, block long, part int, e0 double, e1 double, state int, chain long, ends boolean")

        def label(key, f: pd.DataFrame, borders: pd.DataFrame) -> pd.DataFrame:
            out = []
            borders = borders.set_index("part")
            for part, c in enumerate(chains(f)) if len(f) else ():
                pos, score = c["pos"].to_numpy(), c["score"].to_numpy()
                b = borders.loc[part]
                states, _ = seg.path(np.diff(pos, prepend=pos[0]).astype(float), score, np.array([b["e0"], b["e1"]]), int(b["state"]))
                keep = len(pos) - 1 if b["ends"] else len(pos)
                pos, states = pos[:keep], states[:keep]
                if not keep:
                    continue
                cut = np.flatnonzero(np.diff(states)) + 1
                for x, y in zip([0, *cut], [*cut, keep]):
                    out.append((key[0], int(b["chain"]), int(pos[x]), int(pos[y - 1]) + 1, int(states[x]), y - x, x == 0, y == keep))
            return pd.DataFrame(out, columns=["chrom", "chain", "start", "end", "state", "num_sites", "first", "last"])

        runs = rows.groupBy("chrom", "block").cogroup(fixed.groupBy("chrom", "block")).applyInPandas(label, "chrom string, chain long, start long, end long, state int, num_sites long, first boolean, last boolean")
        runs = materialize(runs)
        # only the runs at the borders of a piece can go on in the next one: two a piece
        w = Window.partitionBy("chrom").orderBy("start")
        joined = F.lag("last").over(w) & F.col("first") & (F.lag("state").over(w) == F.col("state")) & (F.lag("chain").over(w) == F.col("chain"))
        border = runs.where("first or last").withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
        merged = border.groupBy("chrom", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("state").alias("state"), F.sum("num_sites").alias("num_sites")).drop("_run")
        inner = runs.where("not (first or last)").select("chrom", "start", "end", "state", "num_sites")
        state = F.when(F.col("state") == 0, "same").otherwise("different")
        return merged.unionByName(inner).withColumn("state", state)


def segment_rows(segments: DataFrame, scored: DataFrame) -> DataFrame:
    """Segments with the pooled counts, score and effect size of their sites."""
    s = segments.select("chrom", "start", "end", F.concat_ws(":", "chrom", "start").alias("region_name"), F.lit(".").alias("strand"), "state", "num_sites")
    hit = points_in(scored.select(*POSITION, "a_mod", "a_total", "b_mod", "b_total"), s, "chromstart")
    keys = ["chrom", "start", "end", "state", "num_sites"]
    out = hit.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("a_mod", "a_total", "b_mod", "b_total")])
    return out.withColumn("score", stats.llr_beta(F.col("a_mod"), F.col("a_total"), F.col("b_mod"), F.col("b_total"))).withColumn("effect_size", F.col("a_mod") / F.col("a_total") - F.col("b_mod") / F.col("b_total"))
