"""Special functions on numpy arrays, used inside Arrow batches.

Numerically these are the textbook series and continued fractions; they exist
because the image carries no scientific library beyond numpy.
"""

from __future__ import annotations

import numpy as np

# Lanczos coefficients (g = 7, nine terms).
_LANCZOS = (
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
)
_TINY = 1e-300


def log_gamma(z: np.ndarray) -> np.ndarray:
    """log Gamma(z) for positive z."""
    z = np.asarray(z, dtype="float64")
    small = z < 0.5
    s = np.where(small, 1.0 - z, z) - 1.0
    total = np.full_like(s, _LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], start=1):
        total = total + c / (s + i)
    t = s + 7.5
    value = 0.5 * np.log(2 * np.pi) + (s + 0.5) * np.log(t) - t + np.log(total)
    with np.errstate(invalid="ignore", divide="ignore"):
        reflected = np.log(np.pi / np.abs(np.sin(np.pi * z))) - value
    return np.where(small, reflected, value)


def digamma(z: np.ndarray) -> np.ndarray:
    """psi(z) for positive z: shift above 6, then the asymptotic series."""
    z = np.array(z, dtype="float64", copy=True)
    result = np.zeros_like(z)
    for _ in range(6):
        low = z < 6
        result = np.where(low, result - 1 / z, result)
        z = np.where(low, z + 1, z)
    inv2 = 1 / (z * z)
    tail = inv2 * (1 / 12 - inv2 * (1 / 120 - inv2 * (1 / 252 - inv2 * (1 / 240 - inv2 / 132))))
    return result + np.log(z) - 0.5 / z - tail


def trigamma(z: np.ndarray) -> np.ndarray:
    z = np.array(z, dtype="float64", copy=True)
    result = np.zeros_like(z)
    for _ in range(6):
        low = z < 6
        result = np.where(low, result + 1 / (z * z), result)
        z = np.where(low, z + 1, z)
    inv = 1 / z
    inv2 = inv * inv
    return result + inv * (1 + inv / 2 + inv2 * (1 / 6 - inv2 * (1 / 30 - inv2 * (1 / 42 - inv2 / 30))))


def gamma_shape_mle(log_mean_minus_mean_log: np.ndarray) -> np.ndarray:
    """Solve log k - psi(k) = s by Newton from Thom's closed form."""
    s = np.asarray(log_mean_minus_mean_log, dtype="float64")
    k = (1 + np.sqrt(1 + 4 * s / 3)) / (4 * s)
    for _ in range(60):
        step = (np.log(k) - digamma(k) - s) / (1 / k - trigamma(k))
        updated = np.where(k - step > 0, k - step, k / 2)
        done = np.all(np.abs(updated - k) <= 1e-14 * k)
        k = updated
        if done:
            break
    return k


def gamma_cdf(x: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma P(shape, x)."""
    x = np.asarray(x, dtype="float64")
    a = np.broadcast_to(np.asarray(shape, dtype="float64"), x.shape)
    out = np.zeros_like(x)
    positive = x > 0
    series = positive & (x < a + 1)
    if series.any():
        xs, as_ = x[series], a[series]
        term = 1 / as_
        total = term.copy()
        denominator = as_.copy()
        for _ in range(2000):
            denominator += 1
            term = term * xs / denominator
            total += term
            if np.all(np.abs(term) < np.abs(total) * 1e-17):
                break
        out[series] = total * np.exp(-xs + as_ * np.log(xs) - log_gamma(as_))
    fraction = positive & ~series
    if fraction.any():
        xs, as_ = x[fraction], a[fraction]
        b = xs + 1 - as_
        c = np.full_like(xs, 1 / _TINY)
        d = 1 / b
        h = d.copy()
        for i in range(1, 2000):
            an = -i * (i - as_)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            delta = d * c
            h = h * delta
            if np.all(np.abs(delta - 1) < 1e-16):
                break
        out[fraction] = 1 - h * np.exp(-xs + as_ * np.log(xs) - log_gamma(as_))
    return np.clip(out, 0.0, 1.0)


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b)."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, dtype="float64") for v in (x, a, b)))
    flip = x > (a + 1) / (a + b + 2)
    xx = np.where(flip, 1 - x, x)
    aa, bb = np.where(flip, b, a), np.where(flip, a, b)
    inner = (xx > 0) & (xx < 1)
    xs = np.where(inner, xx, 0.5)
    c = np.ones_like(xs)
    d = 1 - (aa + bb) * xs / (aa + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, 500):
        for numerator in (
            m * (bb - m) * xs / ((aa + 2 * m - 1) * (aa + 2 * m)),
            -(aa + m) * (aa + bb + m) * xs / ((aa + 2 * m) * (aa + 2 * m + 1)),
        ):
            d = 1 + numerator * d
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1 + numerator / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-16):
            break
    front = np.exp(
        log_gamma(aa + bb) - log_gamma(aa) - log_gamma(bb) + aa * np.log(xs) + bb * np.log1p(-xs)
    )
    value = np.where(inner, front * h / aa, np.where(xx <= 0, 0.0, 1.0))
    return np.where(flip, 1 - value, value)


def student_t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) with ``df`` degrees of freedom."""
    t = np.asarray(t, dtype="float64")
    df = np.asarray(df, dtype="float64")
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


# Acklam's rational approximation of the normal quantile.
_PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
          1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
          6.680131188771972e01, -1.328068155288572e01, 1.0)
_PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
          -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def normal_cdf(z: np.ndarray) -> np.ndarray:
    z = np.asarray(z, dtype="float64")
    half = 0.5 * gamma_cdf(0.5 * z * z, np.full_like(z, 0.5))
    return np.where(z >= 0, 0.5 + half, 0.5 - half)


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse standard normal: rational start, then two Newton steps."""
    p = np.asarray(p, dtype="float64")
    tail = np.minimum(p, 1 - p)
    q = np.sqrt(-2 * np.log(tail))
    outer = np.polyval(_PPF_C, q) / np.polyval(_PPF_D, q)
    r = (p - 0.5) ** 2
    centre = (p - 0.5) * np.polyval(_PPF_A, r) / np.polyval(_PPF_B, r)
    z = np.where(tail < 0.02425, np.where(p < 0.5, outer, -outer), centre)
    for _ in range(2):
        z = z - (normal_cdf(z) - p) * np.sqrt(2 * np.pi) * np.exp(z * z / 2)
    return z
