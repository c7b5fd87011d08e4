"""Parameters of the jobs, as plain values on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass, field


@dataclass(frozen=True)
class WindowParams:
    """Sliding windows and their features. Times in seconds, inter-arrival edges in milliseconds."""

    window_sec: float = 2.0
    stride_sec: float = 1.0
    size_edges: tuple[float, ...] = (0, 64, 128, 256, 512, 1024, 1518, 9000)
    iat_edges_ms: tuple[float, ...] = (0, 0.1, 1, 5, 10, 50, 100, 500)
    compute_standard: bool = True
    compute_rich: bool = True
    head_bytes: int = 1024
    tail_bytes: int = 1024
    max_events: int = 10
    context_sec: tuple[float, float] = (10.0, 60.0)

    def __post_init__(self) -> None:
        if not (self.compute_standard or self.compute_rich):
            raise ValueError("at least one of compute_standard and compute_rich must be on")
        if self.window_sec <= 0 or self.stride_sec <= 0:
            raise ValueError("window and stride must be positive")

    @property
    def window_us(self) -> int:
        return round(self.window_sec * 1_000_000)

    @property
    def stride_us(self) -> int:
        return round(self.stride_sec * 1_000_000)

    @property
    def context_rows(self) -> tuple[int, int]:
        """Rows of the rolling sums: windows of context_sec counted in strides, at least one."""
        short, long = (max(1, math.ceil(s / max(self.stride_sec, 1e-6))) for s in self.context_sec)
        return short, long


@dataclass(frozen=True)
class LabelParams:
    """Names and conventions of a ground-truth table."""

    benign: str = "BENIGN"
    label: str = "label"
    start: str = "ts_start"
    end: str = "ts_end"
    src_ip: str = "src_ip"
    dst_ip: str = "dst_ip"
    src_port: str = "src_port"
    dst_port: str = "dst_port"
    protocol: str = "protocol"
    capture_id: str = "capture_id"
    flow_id: str = "flow_id"
    timezone: str = "UTC"
    #: Day first; a text is read by the first format that fits.
    time_formats: tuple[str, ...] = ("d/M/y H:m:s.SSSSSS", "d/M/y H:m:s.SSS", "d/M/y H:m:s", "d/M/y H:m", "d/M/y h:m:s a", "d/M/y h:m a", "d-M-y H:m:s", "d.M.y H:m:s", "y-M-d H:m:s.SSSSSS", "y-M-d H:m:s", "y-M-d'T'H:m:s", "y-M-d H:m", "M/d/y H:m:s", "M/d/y H:m")
    default_offset_sec: float = 0.0
    extra_offsets_sec: tuple[float, ...] = ()


DATASETS = {
    "CICIDS2017": LabelParams(extra_offsets_sec=(10_800.0, 54_000.0)),
    "UNSWNB15": LabelParams(benign="Normal", start="start_time", end="end_time"),
}


def dataset(name: str) -> LabelParams:
    if name not in DATASETS:
        raise ValueError(f"unknown dataset {name!r}; known: {sorted(DATASETS)}")
    return DATASETS[name]


@dataclass(frozen=True)
class SplitParams:
    names: tuple[str, ...] = ("train", "val", "test")
    ratios: tuple[float, ...] = (0.7, 0.15, 0.15)
    seed: int = 42

    def __post_init__(self) -> None:
        if len(self.names) != len(self.ratios) or abs(sum(self.ratios) - 1) > 1e-6:
            raise ValueError("one ratio for each name, and a sum of 1")


@dataclass(frozen=True)
class SampleParams:
    benign: str = "BENIGN"
    target: int = 20_000
    benign_ratio: float = 0.75
    natural: int = 5_000
    seed: int = 42
    extra: dict = field(default_factory=dict)
