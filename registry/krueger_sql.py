"""UTM projection as SQL text, for the oracles (zone 35 north)."""

from __future__ import annotations

F_ = 1 / 298.257223563
N_ = F_ / (2 - F_)
RADIUS = 6378137.0 / (1 + N_) * (1 + N_**2 / 4 + N_**4 / 64) * 0.9996
ECC = 2 * N_**0.5 / (1 + N_)
ALPHA = [
    N_ / 2 - 2 * N_**2 / 3 + 5 * N_**3 / 16 + 41 * N_**4 / 180,
    13 * N_**2 / 48 - 3 * N_**3 / 5 + 557 * N_**4 / 1440,
    61 * N_**3 / 240 - 103 * N_**4 / 140,
    49561 * N_**4 / 161280,
]


def project(source: str, keep: str) -> str:
    """SELECT of ``keep, x, y`` from a relation with ``lon, lat``."""
    x = "eta" + "".join(f" + {a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(ALPHA, 1))
    y = "xi" + "".join(f" + {a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(ALPHA, 1))
    inner = (
        f"SELECT *, radians(lon - 27.0) AS dl, sinh(atanh(sin(radians(lat))) - {ECC!r} * atanh({ECC!r} * sin(radians(lat)))) AS tt FROM {source}"
    )
    mid = f"SELECT *, atan2(tt, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + tt * tt)) AS eta FROM ({inner})"
    return f"SELECT {keep}, 500000.0 + {RADIUS!r} * ({x}) AS x, {RADIUS!r} * ({y}) AS y FROM ({mid})"
