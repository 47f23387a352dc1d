"""Distribution functions as Spark columns and as numpy functions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# West's rational form of the normal distribution function.
PHI_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
PHI_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
# Wichura's algorithm AS 241 for the normal quantile, highest power first.
Q_A = (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0)
Q_B = (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0)
Q_C = (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0)
Q_D = (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0)
Q_E = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0)
Q_F = (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0)


def _horner(x, coefficients):
    out = coefficients[0]
    for c in coefficients[1:]:
        out = out * x + c
    return out


def phi(x: Column) -> Column:
    """Normal distribution function."""
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    near = e * _horner(a, PHI_NUM) / _horner(a, PHI_DEN)
    far = e / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
    tail = F.when(a > 37, 0.0).when(a < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def phi_inverse(p: Column) -> Column:
    """Normal quantile; null outside (0, 1)."""
    q = p - 0.5
    r = 0.180625 - q * q
    middle = q * _horner(r, Q_A) / _horner(r, Q_B)
    s = F.sqrt(-F.log(F.least(p, 1 - p)))
    tail = F.when(s <= 5, _horner(s - 1.6, Q_C) / _horner(s - 1.6, Q_D)).otherwise(_horner(s - 5.0, Q_E) / _horner(s - 5.0, Q_F))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, middle).otherwise(F.when(q < 0, -tail).otherwise(tail)))


def norm_cdf(x) -> np.ndarray:
    x = np.asarray(x, float)
    a = np.minimum(np.abs(x), 38.0)
    e = np.exp(-a * a / 2)
    tail = np.where(a < 7.07106781186547, e * _horner(a, PHI_NUM) / _horner(a, PHI_DEN), e / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631)
    return np.where(x > 0, 1 - tail, tail)


def norm_ppf(p) -> np.ndarray:
    p = np.asarray(p, float)
    q = p - 0.5
    r = 0.180625 - q * q
    s = np.sqrt(-np.log(np.clip(np.minimum(p, 1 - p), 1e-320, None)))
    tail = np.where(s <= 5, _horner(s - 1.6, Q_C) / _horner(s - 1.6, Q_D), _horner(s - 5.0, Q_E) / _horner(s - 5.0, Q_F))
    out = np.where(np.abs(q) <= 0.425, q * _horner(r, Q_A) / _horner(r, Q_B), np.sign(q) * tail)
    return np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, out))


lgamma = np.vectorize(math.lgamma, otypes=[float])


def gamma_cdf(x, a) -> np.ndarray:
    """Regularised lower incomplete gamma function: series below a + 1, continued fraction above."""
    log_gamma = lgamma(a)  # before broadcasting: usually one number
    x, a = np.broadcast_arrays(np.asarray(x, float), np.asarray(a, float))
    x = np.maximum(x, 0.0)
    safe = np.maximum(x, 1e-300)
    front = np.exp(a * np.log(safe) - safe - log_gamma)
    term = total = 1.0 / a
    for k in range(1, 400):
        term = term * x / (a + k)
        total = total + term
        if np.all(term <= total * 1e-16):
            break
    tiny = 1e-300
    b = safe + 1 - a
    c, d = np.full(x.shape, 1 / tiny), 1 / np.where(np.abs(b) < tiny, tiny, b)
    h = d
    for k in range(1, 400):
        an = -k * (k - a)
        b = b + 2
        d = 1 / np.where(np.abs(an * d + b) < tiny, tiny, an * d + b)
        c = np.where(np.abs(b + an / c) < tiny, tiny, b + an / c)
        h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return np.where(x <= 0, 0.0, np.where(x < a + 1, np.minimum(front * total, 1.0), 1 - front * h))


def beta_cdf(x, a, b) -> np.ndarray:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    log_beta = lgamma(a) + lgamma(b) - lgamma(np.add(a, b))  # before broadcasting: usually one number
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    x = np.clip(x, 0.0, 1.0)
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    y = np.clip(y, 1e-300, 1 - 1e-16)
    front = np.exp(p * np.log(y) + q * np.log1p(-y) - log_beta) / p
    tiny = 1e-300
    c, d = np.ones(y.shape), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d
    for m in range(1, 500):
        for k in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / np.where(np.abs(1 + k * d) < tiny, tiny, 1 + k * d)
            c = np.where(np.abs(1 + k / c) < tiny, tiny, 1 + k / c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    out = np.where(swap, 1 - front * h, front * h)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def t_cdf(x, df) -> np.ndarray:
    x = np.asarray(x, float)
    if np.isinf(df):
        return norm_cdf(x)
    tail = 0.5 * beta_cdf(df / (df + x * x), df / 2, 0.5)
    return np.where(x > 0, 1 - tail, tail)


def inverse(cdf, p, low, high, turns: int = 80) -> np.ndarray:
    """Quantile of a distribution function on [low, high] by bisection."""
    p = np.asarray(p, float)
    a, b = np.full(p.shape, float(low)), np.full(p.shape, float(high))
    for _ in range(turns):
        m = (a + b) / 2
        under = cdf(m) < p
        a, b = np.where(under, m, a), np.where(under, b, m)
    return (a + b) / 2


def tabulated(quantile, p: np.ndarray) -> np.ndarray:
    """A continuous quantile function at many points: exact at 4001 points that are even on the
    normal scale, linear between them."""
    z = np.linspace(-8.0, 8.0, 4001)
    return np.interp(norm_ppf(np.clip(p, 1e-15, 1 - 1e-15)), z, quantile(norm_cdf(z)))


#: Number of points above which quantiles are interpolated from a table.
MANY = 8000


def t_ppf(p, df) -> np.ndarray:
    p = np.asarray(p, float)
    if np.isinf(df):
        return norm_ppf(p)
    if p.size > MANY:
        return tabulated(lambda v: t_ppf(v, df), p)
    y = inverse(lambda v: beta_cdf(v, df / 2, 0.5), np.clip(2 * np.minimum(p, 1 - p), 1e-300, 1.0), 0.0, 1.0, 120)
    return np.sign(p - 0.5) * np.sqrt(df * (1 / np.maximum(y, 1e-300) - 1))


def gamma_ppf(p, a) -> np.ndarray:
    if np.size(p) > MANY:
        return tabulated(lambda v: gamma_ppf(v, a), np.asarray(p, float))
    return inverse(lambda v: gamma_cdf(v, a), p, 0.0, float(a) + 40 * math.sqrt(float(a)) + 60)


def beta_ppf(p, a, b) -> np.ndarray:
    if np.size(p) > MANY:
        return tabulated(lambda v: beta_ppf(v, a, b), np.asarray(p, float))
    return inverse(lambda v: beta_cdf(v, a, b), p, 0.0, 1.0)


def discrete_ppf(p, masses: np.ndarray, start: int = 0) -> np.ndarray:
    """Smallest value whose cumulated mass reaches p."""
    cum = np.cumsum(masses)
    return start + np.minimum(np.searchsorted(cum, np.asarray(p, float) * min(1.0, cum[-1]), side="left"), len(masses) - 1)


def pois_ppf(p, rate: float) -> np.ndarray:
    k = np.arange(int(rate + 20 * math.sqrt(rate) + 40))
    return discrete_ppf(p, np.exp(k * math.log(rate) - rate - lgamma(k + 1.0)) if rate > 0 else np.array([1.0]))


def binom_ppf(p, size: int, prob: float) -> np.ndarray:
    k = np.arange(size + 1)
    if prob in (0, 1):
        return np.full(np.shape(p), size * prob)
    return discrete_ppf(p, np.exp(math.lgamma(size + 1) - lgamma(k + 1.0) - lgamma(size - k + 1.0) + k * math.log(prob) + (size - k) * math.log1p(-prob)))
