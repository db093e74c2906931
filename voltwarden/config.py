"""Thresholds of the checks. Fixed values that results depend on; queries scale them to their data."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Nlr:
    floor_w: float = 0.0
    ceiling_w: float = 800.0
    gpu_step_w: float = 400.0
    cpu_step_w: float = 16.0
    temp_floor_c: float = 0.0
    temp_ceiling_c: float = 95.0
    temp_step_c: float = 8.0
    wrap_ceiling_uj: float = 65.5e9
    wrap_tolerance_uj: float = 2e9
    energy_step_uj: float = 2.4e9
    recovery_w: float = 150.0
    recovery_c: float = 6.0
    quiet_frames: int = 150
    recovery_run: int = 5
    ramp_low_w: float = 400.0
    ramp_high_w: float = 700.0
    ramp_deadline: int = 200
    ramp_run: int = 5
    replay_gram: int = 4
    replay_lookback: int = 100
    replay_floor_w: float = 5.0
    sibling_gpu_w: tuple[float, float] = (0.85, 1.10)
    sibling_gpu_c: tuple[float, float] = (0.90, 1.15)
    sibling_cpu_w: tuple[float, float] = (0.75, 1.40)
    sync_nodes: int = 4
    sync_fraction: float = 0.5
    sync_step_multiple: float = 1.2


@dataclass(frozen=True)
class Enf:
    nominal_hz: float = 60.0
    tolerance_hz: float = 2.0
    trusted: float = 0.93
    suspect: float = 0.85
    anchor_radius: int = 9
    raw_drift_window: int = 30
    raw_drift_hz: float = 0.6
    alt_window: int = 40
    alt_threshold: float = 0.999
    alt_min_variance: float = 5e-6
    cusum_threshold: float = 5.0
    cusum_baseline: float = 0.03
    cusum_history: int = 60
    warmup: int = 10
    local_window: int = 10
    local_threshold: float = 2.0
    local_recovery: int = 20
    hampel_radius: int = 11
    hampel_sigmas: float = 2.0
    mad_scale: float = 1.4826
    physical_hz: tuple[float, float] = (40.0, 80.0)
    lowpass_order: int = 10
    lowpass_hz: float = 0.02
    sample_hz: float = 0.5


SCORES = {"trusted": 0.95, "suspect": 0.50, "failed": 0.05}
RACK_SIZE, INCIDENT_GAP_S, HISTORY_POINTS, CLOSED_EPISODES = 4, 5.0, 1800, 200
