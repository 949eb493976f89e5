"""Profiles: named settings of indexing and search, and the signature of an index."""

from __future__ import annotations

import os
from dataclasses import dataclass

#: The environment variable that names the default profile.
VARIABLE = "LUMENFRAME_PROFILE"


@dataclass(frozen=True)
class Profile:
    name: str
    patches: int
    dim: int
    oversampling: float
    tile: int
    most_tiles: int
    fps_floor: float
    overlap: float = 0.25
    recognise_text: bool = True

    def signature(self, embedder: str) -> dict[str, str]:
        """What makes vectors and regions of two indexes comparable."""
        return {
            "embedder": embedder, "dim": str(self.dim), "patches": str(self.patches), "tile": str(self.tile),
            "most_tiles": str(self.most_tiles), "overlap": str(self.overlap), "recognise_text": str(self.recognise_text).lower(),
        }


#: Patches, oversampling, tile pixels, most tiles and keyframe rate by profile.
PROFILES = {
    "fast": Profile("fast", 256, 768, 2, 384, 6, 0.2, recognise_text=False),
    "balanced": Profile("balanced", 576, 1152, 4, 288, 64, 0.5),
    "quality": Profile("quality", 1024, 1152, 8, 224, 256, 1.0),
}


def profile(name: str | None = None) -> Profile:
    """By name, else by the environment, else balanced; unknown names raise."""
    name = name or os.environ.get(VARIABLE) or "balanced"
    if name not in PROFILES:
        raise KeyError(f"unknown profile {name!r}; known: {', '.join(PROFILES)}")
    return PROFILES[name]
