"""Columns on per-position modification probabilities (``map<code, double>``).

Probabilities are doubles.  Ties go to canonical, then to the code that sorts first
(ChEBI numbers by value, then letters).  A null map gives null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

CALL = "struct<kind:string,p:double,code:string>"
#: Probabilities of one position that add up to more than this contradict each other.
MOST = 1.000001


def qual_to_prob(q: Column) -> Column:
    return (q + F.lit(0.5)) / F.lit(256.0)


def prob_to_qual(p: Column) -> Column:
    return F.when(p == 1, 255).otherwise(F.floor(p * 256)).cast("int")


def total(probs: Column) -> Column:
    return F.aggregate(F.map_values(probs), F.lit(0.0), lambda a, x: a + x)


def canonical(probs: Column) -> Column:
    return F.lit(1.0) - total(probs)


def preference(code: Column) -> Column:
    """Higher is preferred among equally probable codes."""
    return F.when(code.rlike("^[0-9]+$"), F.lit(1_000_000_000) - code.try_cast("int")).otherwise(-F.ascii(code))


def _classes(probs: Column) -> Column:
    mods = F.transform(F.map_entries(probs), lambda e: F.struct(e["value"].alias("p"), preference(e["key"]).alias("pref"), e["key"].alias("code")))
    can = F.struct(canonical(probs).alias("p"), F.lit(2_000_000_000).alias("pref"), F.lit("-").alias("code"))
    return F.concat(mods, F.array(can))


def _as_call(best: Column, none: str) -> Column:
    kind = F.when(best.isNull(), none).when(best["code"] == "-", "canonical").otherwise("modified")
    return F.struct(kind.alias("kind"), F.coalesce(best["p"], F.lit(0.0)).alias("p"), F.when(best["code"] != "-", best["code"]).alias("code"))


def argmax_call(probs: Column) -> Column:
    """The most probable class; a modification only if it is strictly more probable than canonical."""
    return F.when(probs.isNotNull(), _as_call(F.array_max(_classes(probs)), "filtered"))


@dataclass(frozen=True)
class Thresholds:
    """Pass thresholds.  A code's own comes first, then that of any code of its base
    (under the base letter in ``per_mod``), then the base's, then the default; canonical
    uses the base's, then the default."""

    default: float = 0.0
    per_base: dict = field(default_factory=dict)
    per_mod: dict = field(default_factory=dict)

    @classmethod
    def parse(cls, options: list[str]) -> Thresholds:
        """``0.75`` is the default, ``C:0.75`` the threshold of a base."""
        default, per_base = None, {}
        for o in options:
            name, mark, value = o.rpartition(":")
            number = float(value)
            if not 0 <= number <= 1:
                raise ValueError(f"a threshold is from 0 to 1: {o}")
            if mark:
                if name not in ("A", "C", "G", "T"):
                    raise ValueError(f"not a base: {name}")
                per_base[name] = number
            elif default is not None:
                raise ValueError("two default thresholds")
            else:
                default = number
        return cls(default or 0.0, per_base)

    def with_mods(self, options: list[str]) -> Thresholds:
        """``h:0.8`` is the threshold of a code."""
        return Thresholds(self.default, self.per_base, {**self.per_mod, **{o.rpartition(":")[0]: float(o.rpartition(":")[2]) for o in options}})

    def of_base(self, base: Column) -> Column:
        return F.coalesce(_lookup(self.per_base, base), F.lit(float(self.default)))

    def of_code(self, code: Column, base: Column) -> Column:
        return F.coalesce(_lookup(self.per_mod, code), _lookup(self.per_mod, base), self.of_base(base))


def _lookup(values: dict, key: Column) -> Column:
    out = F.lit(None).cast("double")
    for k, v in values.items():
        out = F.when(key == k, F.lit(float(v))).otherwise(out)
    return out


def threshold_call(probs: Column, base: Column, thresholds: Thresholds) -> Column:
    """The most probable class among those that reach their threshold; else ``filtered``."""

    def passes(c: Column) -> Column:
        return c["p"] >= F.when(c["code"] == "-", thresholds.of_base(base)).otherwise(thresholds.of_code(c["code"], base))

    return F.when(probs.isNotNull(), _as_call(F.array_max(F.filter(_classes(probs), passes)), "filtered"))


def call_to_probs(probs: Column, call: Column) -> Column:
    """The called class gets probability 1 and the others 0; null for a filtered call."""
    return F.when(call["kind"] != "filtered", F.transform_values(probs, lambda k, _: F.when(k == F.coalesce(call["code"], F.lit("-")), 1.0).otherwise(0.0)))


def ignore(probs: Column, code: str) -> Column:
    """Takes a code out and gives its probability in equal parts to the other codes and canonical."""
    share = F.coalesce(F.try_element_at(probs, F.lit(code)), F.lit(0.0)) / F.size(probs)
    rest = F.map_filter(probs, lambda k, _: k != code)
    return F.when(F.map_contains_key(probs, code), F.transform_values(rest, lambda _, v: v + share)).otherwise(probs)


def renormalise_without(probs: Column, code: str) -> Column:
    """Takes a code out and scales the others and canonical to add up to 1."""
    rest = F.map_filter(probs, lambda k, _: k != code)
    whole = F.lit(1.0) - F.coalesce(F.try_element_at(probs, F.lit(code)), F.lit(0.0))
    return F.when(F.map_contains_key(probs, code), F.transform_values(rest, lambda _, v: F.coalesce(F.try_divide(v, whole), F.lit(0.0)))).otherwise(probs)


def convert(probs: Column, source: str, target: str) -> Column:
    """Gives a code's probability to another code, adding to what that has."""
    rest = F.map_filter(probs, lambda k, _: (k != source) & (k != target))
    both = F.coalesce(F.try_element_at(probs, F.lit(source)), F.lit(0.0)) + F.coalesce(F.try_element_at(probs, F.lit(target)), F.lit(0.0))
    return F.when(F.map_contains_key(probs, source), F.map_concat(rest, F.create_map(F.lit(target), both))).otherwise(probs)


def within_edges(position: Column, length: Column, start: int, end: int, inverted: bool = False) -> Column:
    """Keeps positions in [start, length - end), or, inverted, the ends.  A read not
    longer than either trim keeps nothing."""
    inside = (position >= start) & (position < length - end)
    return (~inside if inverted else inside) & (length > start) & (length > end)


def combine_blocks(a: Column, b: Column) -> Column:
    """Two tag blocks of one position: sums by code, null where they contradict each other."""
    both = F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))
    return F.when(a.isNull(), b).when(b.isNull(), a).when(total(both) <= MOST, both)
