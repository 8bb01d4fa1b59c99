"""Transverse Mercator coordinates by Krüger's series to the fourth order, as expressions that any SQL engine reads."""

from __future__ import annotations

# The WGS84 ellipsoid and the scale and false easting of UTM.
AXIS, FLATTENING, SCALE, EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0

N = FLATTENING / (2 - FLATTENING)
RADIUS = AXIS / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = [N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280]
BETA = [N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280]
DELTA = [2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45, 7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45, 56 * N**3 / 15 - 136 * N**4 / 35, 4279 * N**4 / 630]


def _real(x: float) -> str:
    return f"cast('{x!r}' as double)"


def _atanh(x: str) -> str:
    return f"(0.5 * ln((1 + {x}) / (1 - {x})))"


def _sinh(x: str) -> str:
    return f"((exp({x}) - exp(-({x}))) / 2)"


def _cosh(x: str) -> str:
    return f"((exp({x}) + exp(-({x}))) / 2)"


def to_utm(lon: str, lat: str, meridian: float) -> tuple[str, str]:
    """Easting and northing of degrees, in a zone of the northern half with that central meridian."""
    e = _real(2 * N**0.5 / (1 + N))
    s = f"sin(radians({lat}))"
    t = _sinh(f"({_atanh(s)} - {e} * {_atanh(f'({e} * {s})')})")
    d = f"radians({lon} - {_real(meridian)})"
    xi, eta = f"atan2({t}, cos({d}))", _atanh(f"(sin({d}) / sqrt(1 + {t} * {t}))")
    x = " + ".join([eta, *(f"{_real(a)} * cos({2 * j} * {xi}) * {_sinh(f'{2 * j} * {eta}')}" for j, a in enumerate(ALPHA, 1))])
    y = " + ".join([xi, *(f"{_real(a)} * sin({2 * j} * {xi}) * {_cosh(f'{2 * j} * {eta}')}" for j, a in enumerate(ALPHA, 1))])
    k = _real(SCALE * RADIUS)
    return f"({_real(EASTING)} + {k} * ({x}))", f"({k} * ({y}))"


def from_utm(x: str, y: str, meridian: float) -> tuple[str, str]:
    """Longitude and latitude in degrees."""
    k = _real(SCALE * RADIUS)
    xi, eta = f"({y} / {k})", f"(({x} - {_real(EASTING)}) / {k})"
    a = " - ".join([xi, *(f"{_real(b)} * sin({2 * j} * {xi}) * {_cosh(f'{2 * j} * {eta}')}" for j, b in enumerate(BETA, 1))])
    b = " - ".join([eta, *(f"{_real(b)} * cos({2 * j} * {xi}) * {_sinh(f'{2 * j} * {eta}')}" for j, b in enumerate(BETA, 1))])
    chi = f"asin(sin({a}) / {_cosh(f'({b})')})"
    lat = " + ".join([chi, *(f"{_real(d)} * sin({2 * j} * {chi})" for j, d in enumerate(DELTA, 1))])
    return f"({_real(meridian)} + degrees(atan2({_sinh(f'({b})')}, cos({a}))))", f"degrees({lat})"
