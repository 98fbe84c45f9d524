"""The MM/ML/MN tags of modified bases: parsing, decoding, encoding.

A tag is blocks ``<base><strand><codes><mode>,<skip>,<skip>,...;``: skips count bases of
that kind (``N``: any base) in the read's own direction; ``ML`` holds one quality for
each code of each position.  Mode ``?`` leaves the other bases unknown; ``.``, or none,
says that they are canonical.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from strandline.functions.seq import aligned_pairs, reverse_complement
from strandline.schema import CALL_TYPE

_BLOCK = re.compile(r"([ACGTUN])([+-])(\d+|[A-Za-z]+)([?.]?)((?:,\d+)*)\Z")


class TagError(ValueError):
    """``code`` is a short name used in the census of errors."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


@dataclass
class Block:
    base: str
    strand: str
    codes: list[str]
    mode: str
    skips: list[int]

    @property
    def header(self) -> str:
        return f"{self.base}{self.strand}{''.join(self.codes)}{self.mode}"


def parse_mm(mm: str) -> list[Block]:
    out = []
    for part in mm.strip().split(";"):
        if not part:
            continue
        m = _BLOCK.match(part)
        if not m:
            raise TagError("malformed tag")
        base = "T" if m[1] == "U" else m[1]
        codes = [m[3]] if m[3].isdigit() else list(m[3])
        out.append(Block(base, m[2], codes, m[4], [int(x) for x in m[5].split(",")[1:]]))
    return out


def positions_of(seq: str, base: str, skips: list[int]) -> list[int]:
    """Positions in the read's own direction that a list of skips names."""
    places = range(len(seq)) if base == "N" else [i for i, c in enumerate(seq) if c == base]
    out, at = [], -1
    for s in skips:
        at += s + 1
        if at >= len(places):
            raise TagError("skips beyond the end of the read")
        out.append(places[at])
    return out


def skips_of(seq: str, base: str, positions: list[int]) -> list[int]:
    """The inverse of ``positions_of``."""
    places = range(len(seq)) if base == "N" else [i for i, c in enumerate(seq) if c == base]
    rank = {p: k for k, p in enumerate(places)}
    out, last = [], -1
    for p in sorted(positions):
        if p not in rank:
            raise TagError("position of another base")
        out.append(rank[p] - last - 1)
        last = rank[p]
    return out


def decode(seq: str, mm: str, ml: list[int], mn: int | None = None, primary: bool = True) -> dict[tuple[str, str, int], tuple[dict[str, float], bool, bool]]:
    """(mod strand, base, position) to (code probabilities, inferred, explicit mode).

    ``seq`` is in the read's own direction.  Raises ``TagError``: length tag that differs
    from the sequence (it must be there if the record is not primary), too few or too
    many qualities, skips beyond the end, blocks that contradict each other."""
    if mn is not None and mn != len(seq):
        raise TagError("length differs from MN")
    if mn is None and not primary:
        raise TagError("no MN on a non-primary record")
    out: dict = {}
    at = 0
    fill = []
    for b in parse_mm(mm):
        n = len(b.skips) * len(b.codes)
        if at + n > len(ml):
            raise TagError("too few qualities")
        for k, p in enumerate(positions_of(seq, b.base, b.skips)):
            base = seq[p] if b.base == "N" else b.base
            probs = {c: (q + 0.5) / 256 for c, q in zip(b.codes, ml[at + k * len(b.codes) : at + (k + 1) * len(b.codes)])}
            key = (b.strand, base, p)
            if key in out:
                for c, v in out[key][0].items():
                    probs[c] = probs.get(c, 0.0) + v
                if sum(probs.values()) > 1.000001:
                    raise TagError("probabilities add up to more than 1")
            out[key] = (probs, False, b.mode == "?")
        if b.mode != "?":
            fill.append(b)
        at += n
    if at != len(ml):
        raise TagError("too many qualities")
    for b in fill:
        for p, c in enumerate(seq):
            if b.base in (c, "N") and (b.strand, c, p) not in out:
                out[b.strand, c, p] = (dict.fromkeys(b.codes, 0.0), True, False)
            elif b.base in (c, "N") and out[b.strand, c, p][1]:
                out[b.strand, c, p][0].update({x: 0.0 for x in b.codes if x not in out[b.strand, c, p][0]})
    return out


def encode(seq: str, calls: dict[tuple[str, str, int], dict[str, float]], mode: str = "?") -> tuple[str, list[int]]:
    """MM and ML of explicit calls; one block for each strand, base and code, in order."""
    groups: dict[tuple[str, str, str], dict[int, float]] = {}
    for (strand, base, p), probs in calls.items():
        for c, v in probs.items():
            groups.setdefault((base, strand, c), {})[p] = v
    mm, ml = [], []
    for (base, strand, c), at in sorted(groups.items()):
        skips = skips_of(seq, base, list(at))
        mm.append(f"{base}{strand}{c}{mode}" + "".join(f",{s}" for s in skips) + ";")
        ml += [255 if at[p] == 1 else int(at[p] * 256) for p in sorted(at)]
    return "".join(mm), ml


def own_direction(seq: str, reverse: bool) -> str:
    return reverse_complement(seq) if reverse else seq


_FIELDS = "read_id read_no flag chrom fwd_pos ref_pos mod_strand aln_strand base probs inferred explicit read_len".split()


def decode_reads(reads: DataFrame) -> DataFrame:
    """One row per read position with a call (schema ``CALL_TYPE``).  Records without
    tags or with erroneous ones give no row (see ``check_tags``); repeated records are
    told apart by ``read_no`` only if that column is there (else 0)."""
    no = F.col("read_no") if "read_no" in reads.columns else F.lit(0)
    cols = reads.where("seq is not null and mm is not null").select("read_id", no.cast("long").alias("read_no"), "flag", "chrom", "pos", "cigar", "seq", "mm", "ml", "mn")

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                reverse = bool(int(r.flag) & 16)
                seq = own_direction(r.seq.upper(), reverse)
                try:
                    found = decode(seq, r.mm, [] if r.ml is None else [int(x) for x in r.ml], None if pd.isna(r.mn) else int(r.mn), not int(r.flag) & 0x900)
                except TagError:
                    continue
                pairs = {} if int(r.flag) & 4 or r.chrom is None or pd.isna(r.pos) else aligned_pairs(r.cigar, int(r.pos), len(seq), reverse)
                for (strand, base, p), (probs, inferred, explicit) in sorted(found.items()):
                    rows.append((r.read_id, r.read_no, r.flag, r.chrom, p, pairs.get(p, -1), strand, "." if int(r.flag) & 4 else "-" if reverse else "+", base, probs, inferred, explicit, len(seq)))
            yield pd.DataFrame(rows, columns=_FIELDS)

    return cols.mapInPandas(apply, CALL_TYPE)


def reference_strand(mod_strand, aln_strand):
    """Strand of a modification on the reference."""
    return F.when(aln_strand == ".", ".").when(mod_strand == aln_strand, "+").otherwise("-")


def to_positions(calls: DataFrame) -> DataFrame:
    """Decoded calls in the shape of ``operators.calls.positions``.  Positions that are
    only inferred from a tag without a mode are kept as ``nocall``."""
    base = F.when(F.col("mod_strand") == "-", F.translate("base", "ACGT", "TGCA")).otherwise(F.col("base"))
    return calls.select(
        "read_id", F.lit(None).cast("string").alias("sample_id"), "flag", "chrom", "ref_pos", "fwd_pos", "mod_strand",
        reference_strand(F.col("mod_strand"), F.col("aln_strand")).alias("strand"), base.alias("base"), "probs", F.map_keys("probs").alias("codes"),
        F.col("aln_strand").alias("ref_strand"), "read_len", F.lit(0).alias("clip_start"), F.lit(0).alias("clip_end"), F.lit(None).cast("int").alias("base_qual"),
        F.lit(None).cast("string").alias("ref_kmer"), F.lit(None).cast("string").alias("query_kmer"), "inferred", F.lit("call").alias("kind"),
    )


def encode_reads(reads: DataFrame, calls: DataFrame, mode: str = "?") -> DataFrame:
    """Reads with MM, ML and MN written anew from ``calls`` (read_id, flag, mod_strand,
    base, fwd_pos, probs); reads without calls lose their tags."""
    packed = calls.groupBy("read_id", "flag").agg(F.collect_list(F.struct("mod_strand", "base", "fwd_pos", "probs")).alias("c"))

    @F.pandas_udf("mm string, ml array<int>")
    def run(seq: pd.Series, flag: pd.Series, c: pd.Series) -> pd.DataFrame:
        out = []
        for s, f, x in zip(seq, flag, c):
            if s is None or x is None:
                out.append((None, None))
            else:
                own = own_direction(s.upper(), bool(int(f) & 16))
                out.append(encode(own, {(k["mod_strand"], k["base"], int(k["fwd_pos"])): dict(k["probs"]) for k in x}, mode))
        return pd.DataFrame(out, columns=["mm", "ml"])

    both = reads.drop("mm", "ml", "mn").join(packed, ["read_id", "flag"], "left").withColumn("t", run("seq", "flag", "c"))
    return both.withColumn("mm", F.col("t.mm")).withColumn("ml", F.col("t.ml")).withColumn("mn", F.when(F.col("t.mm").isNotNull(), F.length("seq"))).drop("t", "c")


def update_mode(mm, mode: str):
    """Rewrites the mode of every block (``?``, ``.`` or none)."""
    if mode not in ("?", ".", ""):
        raise ValueError("a mode is ?, . or empty")
    return F.regexp_replace(mm, r"([ACGTUN][+-](?:\d+|[A-Za-z]+))[?.]?(?=[,;])", f"$1{mode}")


def check_tags(reads: DataFrame) -> DataFrame:
    """One row per record: tag headers in order and the error, if any (``no tags`` too)."""
    cols = reads.select("read_id", "flag", "seq", "mm", "ml", "mn")

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                headers, error = [], None
                if r.mm is None:
                    error = "no tags"
                elif r.seq is None:
                    error = "no sequence"
                else:
                    try:
                        headers = [b.header for b in parse_mm(r.mm)]
                        flag = int(r.flag)
                        decode(own_direction(r.seq.upper(), bool(flag & 16)), r.mm, [] if r.ml is None else [int(x) for x in r.ml], None if pd.isna(r.mn) else int(r.mn), not flag & 0x900)
                    except TagError as e:
                        error = e.code
                rows.append((r.read_id, headers, error))
            yield pd.DataFrame(rows, columns=["read_id", "headers", "error"])

    return cols.mapInPandas(apply, "read_id string, headers array<string>, error string")


def tracked(checked: DataFrame, observation: Observation) -> DataFrame:
    """Counts used, skipped (no tags or no sequence) and failed records while the result
    of ``check_tags`` is made; ``observation.get`` has them after the first action."""
    skipped = F.col("error").isin("no tags", "no sequence")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return checked.observe(observation, n(F.col("error").isNull()).alias("used"), n(skipped).alias("skipped"), n(F.col("error").isNotNull() & ~skipped).alias("failed"))


def parse_md(md):
    """The MD tag as an array of (kind, n, bases): matches, mismatches (the base of the
    reference) and deletions; null where it is null or can't be read."""
    tokens = F.regexp_extract_all(F.upper(md), F.lit(r"(\d+|\^[ACGT]+|[ACGT])"), F.lit(1))

    def one(t):
        number, gone = t.rlike(r"^\d"), F.startswith(t, F.lit("^"))
        bases = F.when(~number, F.regexp_replace(t, r"^\^", ""))
        n = F.when(number, t.try_cast("int")).otherwise(F.length(bases))
        return F.struct(F.when(number, "match").when(gone, "deletion").otherwise("mismatch").alias("kind"), n.alias("n"), bases.alias("bases"))

    return F.when(F.upper(md).rlike(r"^(\d+|\^[ACGT]+|[ACGT])*$"), F.transform(tokens, one))


def modified_bases(reads: DataFrame) -> DataFrame:
    """(strand, base, code, mode, n): every code of the tags with its strand, primary base
    and mode (``.`` where none is written), and the records that have it.  Records whose
    tag can't be parsed are left out.  Without Python: tags are taken apart by patterns."""
    whole = F.col("mm").rlike(r"^\s*([ACGTUN][+-](\d+|[A-Za-z]+)[?.]?(,\d+)*;?)*\s*$")
    headers = F.regexp_extract_all("mm", F.lit(r"([ACGTUN][+-](?:\d+|[A-Za-z]+)[?.]?)(?=[,;]|\s*$)"), F.lit(1))

    def codes_of(h):
        text, mode = F.regexp_extract(h, r"^..(\d+|[A-Za-z]+)", 1), F.regexp_extract(h, r"([?.])$", 1)
        each = F.when(text.rlike(r"^\d"), F.array(text)).otherwise(F.filter(F.split(text, ""), lambda c: c != ""))
        own = [F.substring(h, 2, 1).alias("strand"), F.translate(F.substring(h, 1, 1), "U", "T").alias("base")]
        return F.transform(each, lambda c: F.struct(*own, c.alias("code"), F.when(mode == "", ".").otherwise(mode).alias("mode")))

    flat = reads.where("mm is not null").where(whole).select(F.inline(F.array_distinct(F.flatten(F.transform(headers, codes_of)))))
    return flat.groupBy("strand", "base", "code", "mode").agg(F.count("*").alias("n"))


def census(checked: DataFrame) -> DataFrame:
    """(kind, name, n, percent): headers of valid records, errors as percentages of all errors."""
    good = checked.where("error is null").select(F.lit("header").alias("kind"), F.explode("headers").alias("name"))
    bad = checked.where("error is not null").select(F.lit("error").alias("kind"), F.col("error").alias("name"))
    by = good.unionByName(bad).groupBy("kind", "name").agg(F.count("*").alias("n"))
    return by.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("kind")))


def repair(donors: DataFrame, acceptors: DataFrame) -> DataFrame:
    """Gives trimmed reads the tags of the untrimmed read of the same name.  The trimmed
    sequence must occur exactly once in the donor's (either direction as stored);
    others are returned with ``error``.  Several donors of a name: the longest, then the
    first by sequence."""
    best = F.max(F.struct(F.length("seq").alias("l"), "seq", "flag", "mm", "ml", "mn")).alias("d")
    d = donors.where("read_id is not null and seq is not null and mm is not null").groupBy("read_id").agg(best)
    both = acceptors.select("read_id", "flag", "chrom", "pos", "cigar", "seq").join(d, "read_id", "left")

    @F.pandas_udf("mm string, ml array<int>, error string")
    def run(seq: pd.Series, flag: pd.Series, dseq: pd.Series, dflag: pd.Series, mm: pd.Series, ml: pd.Series) -> pd.DataFrame:
        out = []
        for s, f, ds, df, m, q in zip(seq, flag, dseq, dflag, mm, ml):
            try:
                if ds is None or s is None:
                    raise TagError("no donor" if ds is None else "no sequence")
                own, full = own_direction(s.upper(), bool(int(f) & 16)), own_direction(ds.upper(), bool(int(df) & 16))
                at = full.find(own)
                if at < 0:
                    raise TagError("not in the donor")
                if full.find(own, at + 1) >= 0:
                    raise TagError("more than once in the donor")
                calls = {(x, b, p - at): probs for (x, b, p), (probs, inferred, _) in decode(full, m, [int(v) for v in q]).items() if not inferred and at <= p < at + len(own)}
                out.append((*encode(own, calls), None))
            except TagError as e:
                out.append((None, None, e.code))
        return pd.DataFrame(out, columns=["mm", "ml", "error"])

    t = both.withColumn("t", run("seq", "flag", F.col("d.seq"), F.col("d.flag"), F.col("d.mm"), F.col("d.ml")))
    return t.select("read_id", "flag", "chrom", "pos", "cigar", "seq", F.col("t.mm").alias("mm"), F.col("t.ml").alias("ml"), F.when(F.col("t.mm").isNotNull(), F.length("seq")).alias("mn"), F.col("t.error").alias("error"))

