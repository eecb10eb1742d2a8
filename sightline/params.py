"""Parameters of all jobs, in one frozen object that is passed around."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # frame gate
    sample_fps: float = 2.0
    grid_width: int = 320
    grid_height: int = 180
    pixel_threshold: float = 10.0
    keep_ratio: float = 0.0005
    dedup_ratio: float = 0.001
    global_ratio: float = 0.25
    min_blob: int = 5
    clock_threshold: float = 0.5
    clock_decay: float = 0.95
    max_per_hour: int = 600
    anchor_s: float = 60.0
    # detections
    person_conf: float = 0.15
    vehicle_conf: float = 0.25
    min_height: float = 16.0
    tiny_height: float = 32.0
    static_iou: float = 0.85
    max_crops: int = 24
    crop_margin: float = 0.20
    recrop_margin: float = 0.25
    # search
    top_k: int = 12
    overfetch: int = 4
    group_window_s: float = 8.0
    event_gap_s: float = 50.0
    scene_boost: float = 1.0
    # verification
    verify_top_n: int = 12
    drop_below: float = 0.3
    verify_weight: float = 0.5


DEFAULT = Params()
