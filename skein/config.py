"""Options of a run, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

from skein.sources.gfa import GfaOptions


@dataclass(frozen=True)
class Config:
    """What a run does; the command line fills it in.

    ``floor`` is a lower limit of the average coverage, and makes copy numbers round
    up. ``partition`` needs a source and a target.
    """

    gfa: GfaOptions = field(default_factory=GfaOptions)
    min_copy: int = 1
    max_copy: int = 10
    floor: float = 0.0
    circular_share: float = 1.0
    max_paths: int = 10_000_000
    partition: bool = False
    adjust: bool = False
    min_arc_cov: int = 0
    min_seg_cov: float = 0.0
    neighbour_steps: int = 0
    neighbour_len: int = 0
    bubbles: bool = False
    arcs_to_segments: bool = False
    source: str | None = None
    target: str | None = None
