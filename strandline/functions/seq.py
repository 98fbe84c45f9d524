"""Sequences, IUPAC sets, k-mers and alignments."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
# IUPAC letters; a set of bases is a mask with bit i for BASES[i].
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT", "X": "ACGT", "U": "T",
}
MASK = {letter: sum(1 << BASES.index(b) for b in bases) for letter, bases in IUPAC.items()}
LETTER = {mask: letter for letter, mask in reversed(MASK.items()) if letter not in "XU"}
FULL = 15


def reverse_complement(seq: str) -> str:
    return seq[::-1].translate(str.maketrans("ACGTURYSWKMBDHVNX[]acgtu", "TGCAAYRSWMKVHDBNX][tgcaa"))


def reverse_complement_column(seq: Column) -> Column:
    """Of a sequence or of a pattern with bracketed sets."""
    return F.translate(F.reverse(seq), "ACGTU[]", "TGCAA][")


def iupac_regex(motif: str) -> str:
    out = []
    for c in motif.upper():
        if c not in IUPAC:
            raise ValueError(f"not an IUPAC letter: {c}")
        out.append(IUPAC[c] if len(IUPAC[c]) == 1 else f"[{IUPAC[c]}]")
    return "".join(out)


@dataclass(frozen=True)
class Motif:
    raw: str
    offset: int

    def __post_init__(self):
        if not 0 <= self.offset < len(self.raw):
            raise ValueError(f"offset {self.offset} is outside of {self.raw}")

    @property
    def length(self) -> int:
        return len(self.raw)

    @property
    def reverse_offset(self) -> int:
        return self.length - 1 - self.offset

    @property
    def pattern(self) -> str:
        return iupac_regex(self.raw)

    @property
    def reverse_pattern(self) -> str:
        return iupac_regex(reverse_complement(self.raw.upper()))

    @property
    def palindrome(self) -> bool:
        return self.pattern == self.reverse_pattern

    def partner(self, pos: int) -> int | None:
        """The position of the same base on the other strand; none without a palindrome."""
        at = pos + self.reverse_offset - self.offset
        return at if self.palindrome and at >= 0 else None

    def hits(self, seq: str) -> list[tuple[int, str]]:
        """(position of the offset base, strand) of every occurrence, overlapping ones too."""
        fwd = [m.start() for m in re.finditer(f"(?={self.pattern})", seq)]
        rev = fwd if self.palindrome else [m.start() for m in re.finditer(f"(?={self.reverse_pattern})", seq)]
        return sorted([(i + self.offset, "+") for i in fwd] + [(i + self.reverse_offset, "-") for i in rev])


def kmer(seq: Column, pos: Column, size: int) -> Column:
    """The k-mer around a position from 0, ``-`` beyond the ends; an even size has one
    base fewer before the position."""
    if not 0 < size <= 50:
        raise ValueError("a k-mer has 1 to 50 bases")
    before = (size - 1) // 2 if size % 2 == 0 else size // 2
    padded = F.concat(F.lit("-" * before), seq, F.lit("-" * size))
    return F.when((pos >= 0) & (pos < F.length(seq)), F.substring(padded, pos.cast("int") + 1, F.lit(size)))


def log_odds(low_pos: Column, low_neg: Column, high_pos: Column, high_neg: Column) -> Column:
    """log2 of (high_pos low_neg) / (low_pos high_neg); 0 for 0/0, infinite for x/0."""
    num, den = (high_pos * low_neg).cast("double"), (low_pos * high_neg).cast("double")
    return F.when((den == 0) & (num == 0), 0.0).when(den == 0, float("inf")).when(num == 0, float("-inf")).otherwise(F.log2(F.try_divide(num, den)))


# ---------------------------------------------------------------- alignments

_CIGAR = re.compile(r"(\d+)([MIDNSHP=X])")


def aligned_pairs(cigar: str, pos: int, read_len: int, reverse: bool) -> dict[int, int]:
    """Forward read position to reference position, for aligned bases."""
    out, q, r = {}, 0, pos
    for n, op in ((int(n), op) for n, op in _CIGAR.findall(cigar or "")):
        if op in "M=X":
            for i in range(n):
                out[read_len - 1 - (q + i) if reverse else q + i] = r + i
            q, r = q + n, r + n
        elif op in "IS":
            q += n
        elif op in "DN":
            r += n
    return out


def query_position(cigar: str, pos: int, at: int) -> int | None:
    """Position in the stored sequence of a reference position; none in a gap or outside."""
    q, r = 0, pos
    for n, op in ((int(n), op) for n, op in _CIGAR.findall(cigar or "")):
        if op in "M=X":
            if r <= at < r + n:
                return q + at - r
            q, r = q + n, r + n
        elif op in "IS":
            q += n
        elif op in "DN":
            r += n
    return None


def soft_clips(cigar: Column, reverse: Column) -> tuple[Column, Column]:
    """Soft-clipped bases at the start and the end, in the read's own direction."""
    first = F.coalesce(F.regexp_extract(cigar, r"^(?:\d+H)?(\d+)S", 1).try_cast("int"), F.lit(0))
    last = F.coalesce(F.regexp_extract(cigar, r"(\d+)S(?:\d+H)?$", 1).try_cast("int"), F.lit(0))
    only = cigar.rlike(r"^(\d+H)?\d+S(\d+H)?$")
    last = F.when(only, 0).otherwise(last)
    return F.when(reverse, last).otherwise(first), F.when(reverse, first).otherwise(last)


def cigar_sum(cigar: Column, ops: str) -> Column:
    runs = F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{ops}]"), F.lit(1))
    return F.aggregate(runs, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def identity_q(nm: Column, cigar: Column, min_length: int = 1) -> Column:
    """−10 log10(1e-5 + NM / (paired + inserted + deleted)); null below the least length."""
    span = cigar_sum(cigar, "M=XID")
    return F.when(cigar_sum(cigar, "M=X") >= min_length, -10.0 * F.log10(1e-5 + F.try_divide(nm.cast("double"), span.cast("double"))))
