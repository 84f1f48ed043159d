"""Search limits: the conjunction of those that are set, each inclusive."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Radius:
    straight: float | None = None
    walking: float | None = None
    steps: int | None = None
    angular: float | None = None
    axmeter: float | None = None

    def limits(self) -> dict[str, float]:
        return {f.name: v for f in fields(self) if (v := getattr(self, f.name)) is not None}

    def only(self, measure: str, *kinds: str) -> None:
        """An error if a limit is set that the measure doesn't apply."""
        if unknown := [k for k in self.limits() if k not in kinds]:
            raise ValueError(f"{measure} takes no limit by {', '.join(unknown)}")

    def split(self) -> list[Radius]:
        """One radius for each limit; an unlimited one gives itself."""
        return [Radius(**{k: v}) for k, v in self.limits().items()] or [self]
