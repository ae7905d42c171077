"""Search settings: the presets, and custom ones within their bounds."""

from __future__ import annotations

from dataclasses import dataclass, replace

from ..functions.fixed import PRESETS, THRESHOLD_RANGE, THRESHOLD_STEP, TOP_K_RANGE, WEIGHT_RANGE, WEIGHT_STEP

CUSTOM = "CUSTOM"


def on_step(value: float, bounds: tuple[float, float], step: float) -> bool:
    steps = (value - bounds[0]) / step
    return bounds[0] <= value <= bounds[1] and abs(steps - round(steps)) < 1e-9


@dataclass(frozen=True)
class Settings:
    """What a search runs with; the keyword weight is what the semantic one leaves."""

    hybrid: bool
    semantic: float
    threshold: float
    k: int
    name: str = CUSTOM

    @property
    def keyword(self) -> float:
        return round(1 - self.semantic, 10)

    @classmethod
    def preset(cls, name: str) -> Settings:
        if name not in PRESETS:
            raise ValueError(f"unknown preset {name}; known: {', '.join(PRESETS)}")
        hybrid, semantic, _, threshold, k = PRESETS[name]
        return cls(hybrid, semantic, threshold, k, name)

    def change(self, **values: object) -> Settings:
        """These settings with some values changed, which makes them custom; values out of bounds or between steps are errors."""
        new = replace(self, name=CUSTOM, **values)  # type: ignore[arg-type]
        problems = [
            "threshold" if not on_step(new.threshold, THRESHOLD_RANGE, THRESHOLD_STEP) else "",
            "semantic weight" if not on_step(new.semantic, WEIGHT_RANGE, WEIGHT_STEP) else "",
            "number of results" if int(new.k) != new.k or not TOP_K_RANGE[0] <= new.k <= TOP_K_RANGE[1] else "",
        ]
        if any(problems):
            raise ValueError("out of bounds: " + ", ".join(p for p in problems if p))
        return self if new == replace(self, name=CUSTOM) else new
