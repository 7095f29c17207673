"""All tunables in one place."""

from __future__ import annotations

from dataclasses import dataclass

PLAYER, BALL = 0, 32


@dataclass(frozen=True)
class Tracking:
    """Defaults of the pipeline; distances in pixels, counts in frames or sightings."""

    start_minute: float = 20
    players: int = 13
    margin_top: int = 50
    margin_side: int = 20
    margin_bottom: int = 20
    ratio_min: float = 0.8
    ratio_max: float = 7.0
    window: int = 48
    window_kept: int = 12
    min_extent: int = 18
    min_absence: int = 8
    max_distance: int = 200
    max_overlap: float = 0.4
    min_confidence: float = 0.15
    progress_every: int = 150
    width: int = 1280
    height: int = 720
    fps: float = 23.976
    #: Re-identification also asks for looks so similar; None leaves looks out. A slot keeps this much of its look at each sighting.
    min_cosine: float | None = None
    look_kept: float = 0.9

    @property
    def hop(self) -> int:
        """Sightings between two looks at a static-object window."""
        return self.window - self.window_kept


@dataclass(frozen=True)
class Association:
    """How boxes become tracks: confidences, the largest cost of a match in each round, and the life of lost tracks in frames.

    Boxes from ``threshold`` on are matched first, those between ``low`` and it
    second; the former begin tracks from ``begin`` on (``threshold`` if None).
    """

    threshold: float = 0.15
    low: float = 0.1
    begin: float | None = None
    match: float = 0.9
    match_low: float = 0.5
    match_new: float = 0.7
    same: float = 0.15
    buffer: int = 150


PLAYER_TRACKS, BALL_TRACKS = Association(), Association(threshold=0.1, match=0.8, buffer=30)
