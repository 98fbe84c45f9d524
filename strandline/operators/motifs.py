"""Motifs: hits in sequences, k-mer tables by modification level, scoring and search.

The search never gathers k-mers: every step asks the k-mer table for sums over candidate
motifs or over bases at positions, in one distributed aggregation, and only those few
numbers reach the driver.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.seq import BASES, FULL, LETTER, MASK, Motif, log_odds
from strandline.session import materialize

# ---------------------------------------------------------------- hits


def motif_hits(sequences: DataFrame, motifs: list[Motif], keep: str = "chrom", seq: str = "seq", upper: bool = True, block: int = 1 << 20) -> DataFrame:
    """(keep, motif, offset, pos, strand) of every occurrence in sequences, whole ones or
    windows of them (with the columns start, before and core of
    ``readers.fasta_windows``, whose overlap must be as long as the motifs).  A palindrome
    is scanned once for both strands.  Null sequences have none.  Hits come out ``block``
    bases at a time, so a long sequence's hits are never held together."""
    kind = sequences.schema[keep].dataType.simpleString()
    windowed = {"start", "before", "core"} <= set(sequences.columns)
    reach = max((m.length for m in motifs), default=1)

    def pieces(s: str, origin: int, low: int, high: int) -> Iterator[tuple[str, int, int, int]]:
        """(text, its position, positions that count: from, up to)"""
        for a in range(low, high, block):
            b = min(high, a + block)
            left, right = max(0, a - origin - reach), b - origin + reach
            yield s[left:right], origin + left, a, b

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, s, origin, low, high in zip(f["k"], f["s"], f["o"], f["a"], f["b"]):
                for text, at, a, b in pieces(s.upper() if upper else s, int(origin), int(low), int(high)):
                    for m in motifs:
                        found = [(p + at, x) for p, x in m.hits(text) if a <= p + at < b]
                        if found:
                            yield pd.DataFrame({"k": name, "motif": m.raw, "offset": m.offset, "pos": [p for p, _ in found], "strand": [x for _, x in found]})

    start, before, core = (F.col("start"), F.col("before"), F.col("core")) if windowed else (F.lit(0), F.lit(0), F.length(seq))
    rows = sequences.select(F.col(keep).alias("k"), F.col(seq).alias("s"), (start - before).cast("long").alias("o"), start.cast("long").alias("a"), (start + core).cast("long").alias("b")).where("s is not null")
    return rows.mapInPandas(apply, f"k {kind}, motif string, offset int, pos long, strand string").withColumnRenamed("k", keep)


# ---------------------------------------------------------------- k-mer tables

LEVELS = ("low", "mid", "high")


def kmer_levels(rows: DataFrame, low: float = 0.2, high: float = 0.6, min_coverage: int = 5) -> DataFrame:
    """``rows``: kmer, code, n_mod, valid_coverage of each position.  (level, kmer, code,
    n): positions with each k-mer that are hardly, partly or highly modified.  K-mers
    with letters other than A, C, G, T are left out."""
    frac = F.col("n_mod") / F.col("valid_coverage")
    level = F.when(frac <= low, "low").when(frac > high, "high").otherwise("mid")
    good = rows.where((F.col("valid_coverage") >= max(1, min_coverage)) & F.col("kmer").rlike("^[ACGT]+$"))
    return good.groupBy(level.alias("level"), "kmer", "code").agg(F.count("*").alias("n"))


Masks = dict[int, int]  # offset from the focus base to a set of bases


def masks_of(motif: str, offset: int) -> Masks:
    return {i - offset: MASK[c] for i, c in enumerate(motif.upper()) if MASK[c] != FULL}


def text_of(masks: Masks, base: str = "N") -> tuple[str, int]:
    """IUPAC text and offset of the focus base, which is ``base``."""
    masks = {0: MASK[base], **{o: m for o, m in masks.items() if o}}
    lo, hi = min([0, *masks]), max([0, *masks])
    return "".join(LETTER[masks.get(i, FULL)] for i in range(lo, hi + 1)), -lo


def matches(kmer: Column, masks: Masks, focus: int) -> Column:
    """Whether a k-mer with its focus base at ``focus`` shows the motif; never if it is too short."""
    out = F.lit(True)
    for offset, mask in masks.items():
        place = focus + offset + 1
        out &= F.substring(kmer, place, 1).isin([b for i, b in enumerate(BASES) if mask >> i & 1]) if place > 0 else F.lit(False)
    return out


def evaluate(kmers: DataFrame, motifs: list[tuple[str, int, str]], focus: int) -> DataFrame:
    """(motif, offset, code, high, low, mid, frac, log_odds) of each (motif, offset,
    code), in one pass over the k-mers.  frac = high / (high + low), null without either."""
    sums = []
    for i, (m, offset, code) in enumerate(motifs):
        hit = matches(F.col("kmer"), masks_of(m, offset), focus)
        for level in LEVELS:
            own = (F.col("code") == code) & (F.col("level") == level)
            sums += [F.sum(F.when(own & hit, F.col("n")).otherwise(0)).alias(f"{level}_{i}"), F.sum(F.when(own & ~hit, F.col("n")).otherwise(0)).alias(f"not_{level}_{i}")]
    one = kmers.agg(*sums)
    rows = [F.struct(F.lit(m).alias("motif"), F.lit(o).alias("offset"), F.lit(c).alias("code"), *[F.coalesce(f"{p}{x}_{i}", F.lit(0)).alias(f"{p}{x}") for x in LEVELS for p in ("", "not_")]) for i, (m, o, c) in enumerate(motifs)]
    flat = one.select(F.inline(F.array(*rows)))
    frac = F.try_divide(F.col("high").cast("double"), (F.col("high") + F.col("low")).cast("double"))
    return flat.select("motif", "offset", "code", "high", "low", "mid", frac.alias("frac"), log_odds(F.col("low"), F.col("not_low"), F.col("high"), F.col("not_high")).alias("log_odds"))


def base_counts(kmers: DataFrame) -> DataFrame:
    """(level, code, place, base, n): bases at each place (from 0) of the k-mers."""
    return kmers.select("level", "code", "n", F.posexplode(F.split("kmer", "")).alias("place", "base")).where("base <> ''").groupBy("level", "code", "place", "base").agg(F.sum("n").alias("n"))


def fixed_seeds(kmers: DataFrame, focus: int, context: tuple[int, int] = (2, 2), min_log_odds: float = 1.5) -> DataFrame:
    """Slices of ``context`` around the focus base that are enriched among highly
    modified positions: log2(high low_total / (low high_total)) at least the threshold."""
    part = F.substring("kmer", focus - context[0] + 1, sum(context) + 1)
    by = kmers.groupBy("code", part.alias("slice")).agg(*[F.sum(F.when(F.col("level") == x, F.col("n")).otherwise(0)).alias(x) for x in ("low", "high")])
    total = kmers.groupBy("code").agg(*[F.sum(F.when(F.col("level") == x, F.col("n")).otherwise(0)).alias(f"{x}_total") for x in ("low", "high")])
    # both tables must know the slice
    joined = by.where("low > 0 and high > 0").join(F.broadcast(total), "code")
    score = F.log2((F.col("high") * F.col("low_total")).cast("double") / (F.col("low") * F.col("high_total")))
    return joined.withColumn("log_odds", score).where(F.col("log_odds") >= min_log_odds).select("code", "slice", "high", "low", "log_odds")


# ---------------------------------------------------------------- search


class Search:
    """Search for motifs of one code of ``base``.  ``kmers``: (level, kmer, n) of that code."""

    def __init__(self, kmers: DataFrame, focus: int, length: int, base: str, min_sites: int = 300, min_frac: float = 0.85, min_log_odds: float = 1.5, seed_log_odds: float = 2.5):
        self.kmers = materialize(kmers.groupBy("level", "kmer").agg(F.sum("n").alias("n")))
        self.focus, self.length, self.base = focus, length, base
        self.min_sites, self.min_frac, self.min_log_odds, self.seed_log_odds = min_sites, min_frac, min_log_odds, seed_log_odds
        self.offsets = [i - focus for i in range(length) if i != focus]
        self.memo: dict[tuple, tuple[int, int]] = {}

    @staticmethod
    def key(m: Masks) -> tuple:
        return tuple(sorted(m.items()))

    def counts(self, motifs: list[Masks]) -> list[tuple[int, int]]:
        """(high, low) of motifs over all k-mers; what is new takes one pass."""
        new = [m for m in {self.key(m): m for m in motifs}.values() if self.key(m) not in self.memo]
        for a in range(0, len(new), 200):
            some = new[a : a + 200]
            sums = [F.sum(F.when(matches(F.col("kmer"), m, self.focus) & (F.col("level") == x), F.col("n")).otherwise(0)) for m in some for x in ("high", "low")]
            row = self.kmers.agg(*sums).first()
            for i, m in enumerate(some):
                self.memo[self.key(m)] = (row[2 * i] or 0, row[2 * i + 1] or 0)
        return [self.memo[self.key(m)] for m in motifs]

    def fracs(self, motifs: list[Masks]) -> list[float]:
        return [h / (h + l) if h + l else 0.0 for h, l in self.counts(motifs)]

    def open_kmers(self, found: list[Masks]) -> DataFrame:
        """K-mers that show none of the motifs found."""
        out = self.kmers
        for m in found:
            out = out.where(~matches(F.col("kmer"), m, self.focus))
        return out

    def extend(self, motif: Masks, subset: DataFrame, iterations: int = 24) -> Masks:
        """Adds the position and base that tell high from low best, until enough sites are
        highly modified; a base that is depleted leaves the enriched ones of its position."""
        motif = dict(motif)
        for _ in range(iterations):
            own = subset.where(matches(F.col("kmer"), motif, self.focus) & (F.col("level") != "mid"))
            rows = own.select("level", "n", F.posexplode(F.split("kmer", "")).alias("place", "base")).where("base <> ''").groupBy("level", "place", "base").agg(F.sum("n").alias("n")).collect()
            n = {(r["level"], r["place"], r["base"]): r["n"] for r in rows}
            total = {x: sum(n.get((x, self.focus, b), 0) for b in BASES) for x in ("high", "low")}
            if min(total.values()) < self.min_sites or self.fracs([motif])[0] > self.min_frac:
                break
            scores = []
            for offset in self.offsets:
                if motif.get(offset, FULL) in (1, 2, 4, 8):
                    continue
                for i, b in enumerate(BASES):
                    if offset in motif and motif[offset] >> i & 1:
                        continue
                    h, l = n.get(("high", offset + self.focus, b), 0), n.get(("low", offset + self.focus, b), 0)
                    scores.append((_log_odds(l, total["low"] - l, h, total["high"] - h), offset, i))
            if not scores:
                break
            # ties: the position nearest to the left, then the base in order
            top, offset, base = max(scores, key=lambda s: (abs(s[0]), -s[1], -s[2]))
            if abs(top) < self.min_log_odds:
                break
            mask = 1 << base if top > 0 else sum(1 << i for s, o, i in scores if o == offset and s > 0)
            if not mask:
                break
            motif[offset] = mask
        return motif

    def add(self, motif: Masks) -> Masks:
        """Adds bases with which the sites stay highly modified."""
        motif = dict(motif)
        while True:
            options = [(o, 1 << i) for o, m in motif.items() for i in range(4) if not m >> i & 1]
            fracs = self.fracs([{**motif, o: b} for o, b in options])
            new = [(o, b) for (o, b), f in zip(options, fracs) if f > self.min_frac]
            if not new:
                return {o: m for o, m in motif.items() if m != FULL}
            for o, b in new:
                motif[o] |= b

    def contract(self, motif: Masks) -> Masks:
        """Takes bases out (an emptied position is free again) while the rest stays highly modified."""
        motif = dict(motif)
        while True:
            options = []
            for o, m in motif.items():
                for i in range(4):
                    if m >> i & 1:
                        rest = {**motif, o: m & ~(1 << i)}
                        options.append(({k: v for k, v in rest.items() if v}, BASES[i]))
            counted = self.counts([m for m, _ in options])
            good = [(h / (h + l), h, b, m) for (m, b), (h, l) in zip(options, counted) if h + l and h / (h + l) > self.min_frac]
            if not good:
                return motif
            motif = max(good, key=lambda g: g[:3])[3]

    def refine(self, motif: Masks, subset: DataFrame | None = None) -> Masks:
        motif = {o: m for o, m in motif.items() if o}  # the focus base is given
        motif = self.add(self.extend(motif, self.kmers if subset is None else subset))
        seen = []
        while motif not in seen:
            seen.append(motif)
            motif = self.add(self.contract(motif))
        return motif

    def good(self, motif: Masks) -> bool:
        high, low = self.counts([motif])[0]
        return bool(motif) and high >= self.min_sites and high / (high + low) > self.min_frac

    def exhaustive_seeds(self, subset: DataFrame, size: int = 3) -> list[Masks]:
        """All seeds of ``size`` bases whose log odds reach the seed threshold, best first."""
        sets = list(itertools.combinations(self.offsets, size))
        parts = [F.concat(*[F.substring("kmer", o + self.focus + 1, 1) for o in s]) for s in sets]
        rows = subset.where("level <> 'mid'").select("level", "n", F.posexplode(F.array(*parts)).alias("s", "bases"))
        by = rows.groupBy("s", "bases").agg(*[F.sum(F.when(F.col("level") == x, F.col("n")).otherwise(0)).alias(x) for x in ("high", "low")])
        total = subset.agg(*[F.sum(F.when(F.col("level") == x, F.col("n")).otherwise(0)).alias(x) for x in ("high", "low")]).first()
        th, tl = total["high"] or 0, total["low"] or 0
        score = log_odds(F.col("low"), tl - F.col("low"), F.col("high"), th - F.col("high"))
        kept = by.where((F.col("high") >= self.min_sites) & (score >= self.seed_log_odds)).orderBy(score.desc(), "s", "bases").collect()
        return [{o: 1 << BASES.index(b) for o, b in zip(sets[r["s"]], r["bases"])} for r in kept]

    def run(self, context: tuple[int, int] = (2, 2), seed_size: int = 3) -> list[Masks]:
        """Seeds of the fixed context, then none, then all seeds of a size; contexts of
        motifs found are masked after each round.  Rounds of a kind end with the first that
        finds nothing new, or comes back to motifs that were found before."""
        found: list[Masks] = []
        states = [found]
        while True:
            subset = self.open_kmers(found)
            rows = fixed_seeds(subset.withColumn("code", F.lit("x")), self.focus, context, self.min_log_odds).collect()
            seeds = cluster([r["slice"] for r in rows])
            refined = []
            for s in seeds:
                m = self.refine({i - context[0]: mask for i, mask in enumerate(s) if mask != FULL and i != context[0]}, subset)
                if self.good(m) and m not in refined and not any(is_superset(m, f) for f in found):
                    refined.append(m)
            newer = merge(found + refined)
            if not refined or newer in states:
                break
            found = newer
            states.append(newer)
        while True:
            m = self.refine({}, self.open_kmers(found))
            newer = merge([*found, m])
            if not self.good(m) or any(is_superset(m, f) for f in found) or newer in states:
                break
            found = newer
            states.append(newer)
        if seed_size <= len(self.offsets):
            subset = self.open_kmers(found)
            for seed in self.exhaustive_seeds(subset, seed_size):
                if any(is_superset(seed, f) for f in found):
                    continue
                m = self.refine(seed, subset)
                if self.good(m) and not any(is_superset(m, f) for f in found):
                    found = merge([*found, m])
        return found

    def table(self, found: list[Masks]) -> list[tuple[str, int, int, int, float]]:
        """(motif, offset, high, low, frac), most modified first."""
        rows = [(*text_of(m, self.base), *c, c[0] / max(1, sum(c))) for m, c in zip(found, self.counts(found))]
        return sorted(rows, key=lambda r: (-r[4], r[0]))


def _log_odds(low_pos: int, low_neg: int, high_pos: int, high_neg: int) -> float:
    num, den = high_pos * low_neg, low_pos * high_neg
    return 0.0 if not num and not den else math.inf if not den else -math.inf if not num else math.log2(num / den)


def cluster(kmers: list[str]) -> list[list[int]]:
    """Sets of bases of k-mers that are linked by single differences."""
    left, out = sorted(set(kmers)), []
    while left:
        group, queue = [], [left.pop(0)]
        while queue:
            k = queue.pop()
            group.append(k)
            near = [x for x in left if sum(a != b for a, b in zip(k, x)) == 1]
            left = [x for x in left if x not in near]
            queue += near
        out.append([sum({1 << BASES.index(g[i]) for g in group}) for i in range(len(group[0]))])
    return out


def is_superset(a: Masks, b: Masks) -> bool:
    """Fixed places of ``a`` include those of ``b``, and sets at shared places include ``b``'s."""
    return all(o in a and a[o] | m == a[o] for o, m in b.items())


def relation(a: Masks, b: Masks) -> str:
    """equal, subset, superset or disjoint."""
    if a == b:
        return "equal"
    if all(o in b and b[o] | m == b[o] for o, m in a.items()):
        return "subset"
    return "superset" if is_superset(a, b) else "disjoint"


def merge(motifs: list[Masks]) -> list[Masks]:
    """Removes motifs that another one absorbs, largest absorber first, to a fixed point."""
    motifs = [m for i, m in enumerate(motifs) if m not in motifs[:i]]
    while True:
        absorbed = {i: [j for j, b in enumerate(motifs) if i != j and is_superset(a, b)] for i, a in enumerate(motifs)}
        best = max(absorbed, key=lambda i: len(absorbed[i]), default=None)
        if best is None or not absorbed[best]:
            return motifs
        motifs = [m for j, m in enumerate(motifs) if j not in absorbed[best]]


def primary_base(hits: DataFrame) -> DataFrame:
    """``hits``: code, base of each position.  The most frequent base of each code, its
    share, and whether another base occurs too."""
    by = hits.where("base is not null").groupBy("code", "base").agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", F.expr("-ascii(base)").alias("o"), "base")).alias("b")
    return by.groupBy("code").agg(best, F.sum("n").alias("total"), F.count("*").alias("bases")).select("code", F.col("b.base").alias("base"), (F.col("b.n") / F.col("total")).alias("share"), (F.col("bases") > 1).alias("conflict"))
