"""A user's settings, kept as JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

from shutterlake.functions.media import Bands, Profile, PROFILES


@dataclass(frozen=True)
class Settings:
    """Everything that a library's owner may choose; unknown keys of a file are dropped, missing ones keep these values."""

    kinds: list[str] = field(default_factory=lambda: ["image", "video"])
    least_size: int = 0
    ignored_extensions: list[str] = field(default_factory=list)
    ignored_folders: list[str] = field(default_factory=list)
    similarity: str = "medium"
    bands: list[float] = field(default_factory=list)
    weights: dict[str, float] = field(default_factory=dict)
    video_threshold: float = 84.0
    name_pattern: str = "%Y%m%d_%H%M%S"
    no_location: str = "Sin ubicación"
    lower_extensions: bool = True
    country_aliases: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def load(path: str) -> Settings:
        """The settings of a file; the defaults if it is missing, unreadable or no JSON object."""
        try:
            raw = json.loads(Path(path).read_text(encoding="utf-8"))
        except (OSError, ValueError):
            return Settings()
        known = {f.name for f in fields(Settings)}
        return Settings(**{k: v for k, v in raw.items() if k in known}) if isinstance(raw, dict) else Settings()

    def wanted_kinds(self) -> tuple[str, ...]:
        """What is analysed: images alone if nothing is chosen."""
        return tuple(k for k in ("image", "video") if k in self.kinds) or ("image",)

    def profile(self) -> Profile:
        """The named profile; 'custom' takes the bands and weights given here, clamped, on top of the medium one's."""
        if self.similarity != "custom":
            return PROFILES.get(self.similarity, PROFILES["medium"])
        base = PROFILES["medium"]
        weights = tuple((k, float(self.weights.get(k, w))) for k, w in base.weights)
        return Profile((Bands(*[float(b) for b in self.bands[:3]]) if self.bands else base.bands).clamped(), base.crops, weights)
