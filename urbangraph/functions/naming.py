"""Names of result columns: analysis, distance, radius, decay, weight, normalisation, extra and unit, in this order."""

from __future__ import annotations

from urbangraph.radii import Radius

#: Letters of distances.
LETTERS = {"straight": "s", "walking": "w", "steps": "t", "angular": "a", "axmeter": "x"}


def number(x: float) -> str:
    """Whole thousands with k."""
    if x and x % 1000 == 0:
        return f"{int(x // 1000)}k"
    return f"{x:g}".replace(".", "_")


def radius_name(radius: Radius) -> str:
    return "".join(f"{LETTERS[k]}{number(v)}" for k, v in radius.limits().items())


def column_name(analysis: str, distance: str = "", radius: Radius | None = None, decay: str = "", weight: str = "", normalisation: str = "", extra: str = "", unit: str = "") -> str:
    return "".join([analysis, LETTERS.get(distance, distance), radius_name(radius or Radius()), decay, weight, normalisation, extra, unit])


def short(name: str) -> str:
    return name[:2].lower()
