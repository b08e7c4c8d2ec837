"""Every threshold of the detection rules, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    """Fixed values of the state engine's rules."""

    grid_cols: int = 8
    grid_rows: int = 6
    snapshot_every: int = 300
    copy_residual: float = 6.0
    big_residual: float = 45.0
    flash_residual: float = 30.0
    flash_fraction: float = 0.45
    flash_shift: float = 12.0
    return_fraction: float = 0.15
    return_shift: float = 4.0
    cut_fraction: float = 0.6
    cut_histogram: float = 0.3
    cut_cooldown: int = 30
    decay_copy: float = 0.998
    decay_propagated: float = 0.995
    reinfer_below: float = 0.55
    reread_confidence: float = 0.95
    warn_below: float = 0.3
    warn_gap: int = 600
    partial_area: float = 0.6
    hide_after: int = 4
    remove_after_s: float = 3.0
    confirm_hits: int = 10
    confirm_move: float = 0.012
    reid_color: float = 60.0
    reid_distance: float = 0.5
    votes: int = 4
    vote_window: int = 7
    vote_expire_s: float = 2.0
    vote_persist_s: float = 0.1
    emit_move: float = 0.006
    bbox_sample_gap: int = 30
    budget_share: float = 0.03
    budget_extra: int = 8
    chars_per_token: float = 3.5
    budget_margin: float = 0.96


DEFAULT = Thresholds()
