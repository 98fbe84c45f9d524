"""Log-gamma, log-beta and likelihood ratios as columns, and beta-difference p-values.

Everything but the p-value stays in the JVM: log-gamma is Stirling's series after a shift
of the argument by 8, exact to about 1e-13 of the value for arguments from 0.5.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_SHIFT = 8


def ln_gamma(x: Column) -> Column:
    z = x + _SHIFT
    product = x
    for k in range(1, _SHIFT):
        product = product * (x + k)
    i = F.lit(1.0) / z
    i2 = i * i
    series = i * (F.lit(1 / 12) - i2 * (F.lit(1 / 360) - i2 * (F.lit(1 / 1260) - i2 * (F.lit(1 / 1680) - i2 * F.lit(1 / 1188)))))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def _signed(terms: list[tuple[int, Column]]) -> Column:
    """Sum of sign x ln_gamma(argument).  The series is written once, inside a lambda:
    spelt out for every term it would outgrow what can be compiled."""
    both = F.array(*[F.struct(F.lit(float(sign)).alias("s"), x.cast("double").alias("x")) for sign, x in terms])
    return F.aggregate(both, F.lit(0.0), lambda a, t: a + t["s"] * ln_gamma(t["x"]))


def ln_beta(a: Column, b: Column) -> Column:
    return _signed([(1, a), (1, b), (-1, a + b)])


def llr_beta(ka: Column, na: Column, kb: Column, nb: Column) -> Column:
    """Score of two samples with one modification: the posterior is used as prior again,
    so counts enter twice."""
    terms = []
    for sign, k, n in ((1, ka, na), (1, kb, nb), (-1, ka + kb, na + nb)):
        for way, f in ((sign, 2), (-sign, 1)):
            terms += [(way, f * k + 0.5), (way, f * (n - k) + 0.5), (-way, f * n + 1.0)]
    return _signed(terms)


# As SQL text: expressions of this size are put together faster that way than column by column.


def ln_gamma_sql(x: str) -> str:
    z = f"({x} + {_SHIFT})"
    product = " * ".join(f"({x} + {k})" for k in range(_SHIFT))
    series = f"(1D / 12 - (1D / 360 - (1D / 1260 - (1D / 1680 - 1D / 1188 / ({z} * {z})) / ({z} * {z})) / ({z} * {z})) / ({z} * {z})) / {z}"
    return f"(({z} - 0.5D) * ln({z}) - {z} + {0.5 * math.log(2 * math.pi)}D + {series} - ln({product}))"


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def llr_beta_sql(ka: str, na: str, kb: str, nb: str) -> str:
    """``llr_beta`` of expressions."""
    terms = []
    for sign, k, n in ((1, ka, na), (1, kb, nb), (-1, f"({ka} + {kb})", f"({na} + {nb})")):
        for way, f in ((sign, 2), (-sign, 1)):
            terms += [(way, f"{f} * {k} + 0.5D"), (way, f"{f} * ({n} - {k}) + 0.5D"), (-way, f"{f} * {n} + 1D")]
    both = ", ".join(f"named_struct('s', {s}D, 'x', {x})" for s, x in terms)
    return f"aggregate(array({both}), 0D, (a, t) -> a + t.s * {ln_gamma_sql('t.x')})"


def _marginal_sql(counts: str) -> str:
    each = f"aggregate({counts}, 0D, (s, x) -> s + {ln_gamma_sql('(2 * x + 0.5D)')} - {ln_gamma_sql('(x + 0.5D)')})"
    whole = f"aggregate({counts}, 0D, (s, x) -> s + x)"
    of_sum = let(whole, "w", f"{ln_gamma_sql(f'(2 * w + 0.5D * size({counts}))')} - {ln_gamma_sql(f'(w + 0.5D * size({counts}))')}")
    return f"({each} - {of_sum})"


def llr_dirichlet_sql(a: str, b: str) -> str:
    """The same for arrays of counts (double) of equal length: classes, canonical among them."""
    parts = (let(a, "v", _marginal_sql("v")), let(b, "v", _marginal_sql("v")), let(f"zip_with({a}, {b}, (x, y) -> x + y)", "v", _marginal_sql("v")))
    return f"({parts[0]} + {parts[1]} - {parts[2]})"


# ---------------------------------------------------------------- MAP p-value

# Bounds of the quadrature, nudge of the effect size, ceiling of coverage.
LOWER, UPPER, NUDGE, MAX_COVERAGE = 1e-5, 1 - 1e-5, 0.005, 300
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(16)
_U = (_NODES + 1) / 2 * (UPPER - LOWER) + LOWER
_W = _WEIGHTS / 2 * (UPPER - LOWER)
_LN_U, _LN_1U = np.log(_U), np.log1p(-_U)


def np_ln_gamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    z = x + _SHIFT
    product = x.copy()
    for k in range(1, _SHIFT):
        product = product * (x + k)
    i2 = 1 / (z * z)
    series = (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 * (1 / 1680 - i2 / 1188)))) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def np_ln_beta(a, b):
    return np_ln_gamma(a) + np_ln_gamma(b) - np_ln_gamma(np.asarray(a) + b)


def ln_appell_f1(x, y, a, b1, b2, c) -> np.ndarray:
    """ln F1(a; b1, b2; c; x, y) by 16-point Gauss-Legendre quadrature; arrays of one shape."""
    x, y, a, b1, b2, c = (np.asarray(v, float)[..., None] for v in (x, y, a, b1, b2, c))
    e = (a - 1) * _LN_U + (c - a - 1) * _LN_1U - b1 * np.log(1 - _U * x) - b2 * np.log(1 - _U * y)
    top = e.max(-1, keepdims=True)
    return np.log((np.exp(e - top) * _W).sum(-1)) + top[..., 0] - np_ln_beta(a[..., 0], (c - a)[..., 0])


def _ln_density(d, a1, b1, a2, b2, zero: bool):
    """ln of the density of p1 - p2 at d, for Beta(a1, b1) and Beta(a2, b2)."""
    whole = np_ln_beta(a1, b1) + np_ln_beta(a2, b2)
    if zero:
        return np_ln_beta(a1 + a2 - 1, b1 + b2 - 1) - whole
    size, flip = np.abs(d), d < 0
    # d < 0 is d > 0 with the samples exchanged; the quadrature is symmetric in its two variables
    p, q = np.where(flip, a2, a1), np.where(flip, b2, b1)
    r, s = np.where(flip, a1, a2), np.where(flip, b1, b2)
    f1 = ln_appell_f1(1 - size, 1 - size**2, q, p + q + r + s - 2, 1 - p, r + q)
    return np_ln_beta(r, q) + np.log(size) * (q + s - 1) + np.log1p(-size) * (r + q - 1) + f1 - whole


def map_p_value(ka, na, kb, nb, cap_a: int, cap_b: int, prior: tuple[float, float] = (0.55, 0.55), delta: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(p-value, effect size) of sites: the density of the difference at 0 relative to
    that at the effect met.  Coverage above a cap is scaled to it; effects up to
    ``delta``, and densities of 0, give 1.  Arrays of counts; without coverage NaN."""

    def resize(k, n, cap):
        cap = min(cap, MAX_COVERAGE)
        k, n = np.asarray(k, float), np.asarray(n, float)
        with np.errstate(all="ignore"):
            k = np.where(n > cap, np.floor(k / n * cap + 0.5), k)
        return k, np.minimum(n, cap)

    ka, na = resize(ka, na, cap_a)
    kb, nb = resize(kb, nb, cap_b)
    with np.errstate(all="ignore"):
        effect = ka / na - kb / nb
        d = np.where(effect > 0, effect - NUDGE, effect + NUDGE)
        d = np.where(np.abs(effect) <= delta, 0.5, d)
        args = (prior[0] + ka, prior[1] + na - ka, prior[0] + kb, prior[1] + nb - kb)
        near = _ln_density(np.zeros_like(d), *args, zero=True)
        far = np.where(np.abs(d) < delta, near, _ln_density(d, *args, zero=False))
        p = np.minimum(1, np.exp(near - far))
    p = np.where((np.abs(effect) <= delta) | (np.exp(far) == 0), 1.0, p)
    return np.where(np.isnan(effect), np.nan, p), effect
