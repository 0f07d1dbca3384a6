"""Generation parameters with their defaults and ranges, and required settings."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from . import constants as C

#: Smallest and largest value of each parameter.
RANGES = {
    "text_temperature": (0.2, 1.2),
    "text_top_k": (10, 500),
    "audio_temperature": (0.2, 1.2),
    "audio_top_k": (10, 500),
    "pad_mult": (-4.0, 4.0),
    "repetition_penalty_context": (0, 200),
    "repetition_penalty": (1.0, 2.0),
}


@dataclass(frozen=True)
class Parameters:
    text_temperature: float = C.TEXT_TEMPERATURE
    text_top_k: int = C.TEXT_TOP_K
    audio_temperature: float = C.AUDIO_TEMPERATURE
    audio_top_k: int = C.AUDIO_TOP_K
    pad_mult: float = 0.0
    repetition_penalty_context: int = 64
    repetition_penalty: float = 1.0
    seed: int = -1

    def __post_init__(self) -> None:
        for f in fields(self):
            low, high = RANGES.get(f.name, (float("-inf"), float("inf")))
            if not low <= getattr(self, f.name) <= high:
                raise ValueError(f"{f.name} must be between {low} and {high}")

    def with_(self, **changes: float) -> Parameters:
        """A copy with other values; None leaves a value as it is, 0 is a value."""
        return replace(self, **{k: v for k, v in changes.items() if v is not None})


def required(settings: Mapping[str, str], *names: str) -> dict[str, str]:
    """The named settings; raises if one is missing or empty."""
    absent = [n for n in names if not settings.get(n)]
    if absent:
        raise KeyError(f"missing settings: {', '.join(absent)}")
    return {n: settings[n] for n in names}
