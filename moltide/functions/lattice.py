"""Small exact lattice helpers on the driver: Miller indices, bases, greatest common divisors, site names."""

from __future__ import annotations

import math
import re
from fractions import Fraction

import numpy as np


def element_of(site: str) -> str:
    """A site's element: its name without digits."""
    return re.sub(r"[0-9]", "", site)


def gcd_of(numbers: list[int]) -> int:
    return math.gcd(*map(int, numbers))


def miller_to_cart(v, cell, normalise: bool = False) -> np.ndarray:
    r = np.asarray(v, float) @ np.asarray(cell, float).reshape(3, 3)
    n = np.linalg.norm(r)
    return r / n if normalise and n > 1e-12 else r


def cart_to_miller(r, cell, limit: int = 1000) -> list[int]:
    """Smallest whole numbers in the direction of a Cartesian vector."""
    s = np.asarray(r, float) @ np.linalg.inv(np.asarray(cell, float).reshape(3, 3))
    top = np.abs(s).max()
    if top < 1e-12:
        return [0, 0, 0]
    parts = [Fraction(float(c / top)).limit_denominator(limit) for c in s]
    common = math.lcm(*(p.denominator for p in parts))
    whole = [int(p * common) for p in parts]
    g = math.gcd(*whole) or 1
    return [w // g for w in whole]


def basis_along(path, cell, miller: bool = True) -> np.ndarray:
    """Three unit vectors as rows: the direction and two perpendicular to it."""
    w = miller_to_cart(path, cell) if miller else np.asarray(path, float)
    w = w / np.linalg.norm(w)
    other = np.eye(3)[int(np.abs(w).argmin())]
    u = np.cross(w, other)
    u /= np.linalg.norm(u)
    return np.stack([w, u, np.cross(w, u)])


def change_basis(points, cell, basis, miller: bool = True) -> np.ndarray:
    """Components of points (Miller or Cartesian) along the basis vectors."""
    p = np.asarray(points, float)
    r = p @ np.asarray(cell, float).reshape(3, 3) if miller else p
    return r @ np.linalg.inv(np.asarray(basis, float))


def formula_atoms(formula: str) -> list[str]:
    """Symbols of a formula such as C2H5OH, in order."""
    found = re.findall(r"([A-Z][a-z]?)(\d*)", formula)
    if "".join(s + n for s, n in found) != formula:
        raise ValueError(f"no formula: {formula!r}")
    return [s for s, n in found for _ in range(int(n or 1))]


def windows(items: list, length: int = 2) -> list[list]:
    """Overlapping windows of a list, none if it is too short."""
    return [items[i : i + length] for i in range(len(items) + 1 - length)]
