"""Settings of a run, from JSON: types, ranges and names are checked, and what is not known is an error."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any

from .identity.model import Settings

POLICIES = ("identity", "fixed-cosine", "clean-core")
# Settings that older runs had and that mean nothing now.
RETIRED = frozenset({"max_algorithmic_delay_sec", "publication_age_limit_sec", "merge", "core_max_overlap_fraction", "identity_shadow_twin", "hierarchical_posterior_freeze"})
MISMATCH_SEC, MISMATCH_SHARE = 30.0, 0.05  # by which a declared duration may differ from the file's


def positive(value: Any, name: str, zero: bool = False) -> float:
    """value as a finite float above 0 (or from 0 on)."""
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        raise ValueError(f"{name} must be a number")
    x = float(value)
    if not math.isfinite(x) or x < 0 or (x == 0 and not zero):
        raise ValueError(f"{name} must be finite and {'not negative' if zero else 'positive'}")
    return x


@dataclass(frozen=True)
class Stream:
    """Windows of context seconds every step seconds; what ends right_context seconds before a tick is stable."""

    step_sec: float = 2.0
    context_sec: float = 60.0
    right_context_sec: float = 2.0
    overlap_sec_min: float = 0.20
    overlap_fraction_min: float = 0.15
    empty_grace_ticks: int = 1
    best_effort_publish_sec: float | None = None
    max_wall_latency_sec: float | None = None

    def __post_init__(self):
        positive(self.step_sec, "step_sec")
        positive(self.context_sec, "context_sec")
        for name in ("right_context_sec", "overlap_sec_min", "overlap_fraction_min"):
            positive(getattr(self, name), name, zero=True)
        for name in ("best_effort_publish_sec", "max_wall_latency_sec"):
            if getattr(self, name) is not None:
                positive(getattr(self, name), name)
        if self.context_sec < self.step_sec or self.right_context_sec >= self.context_sec or self.overlap_fraction_min > 1:
            raise ValueError("a window must hold a step, and more than its right context")
        if isinstance(self.empty_grace_ticks, bool) or not isinstance(self.empty_grace_ticks, int) or self.empty_grace_ticks < 0:
            raise ValueError("empty_grace_ticks must be a whole number")

    @property
    def delay_sec(self) -> float:
        """Algorithmic delay: a step and the right context."""
        return self.step_sec + self.right_context_sec


@dataclass(frozen=True)
class Inference:
    endpoint: str | None = None
    temperature: float = 0.0
    timeout_sec: float | None = None
    max_completion_tokens: int = 2048
    short_window_tokens: int = 512
    short_window_sec: float = 9.0
    tail_tolerance_sec: float = 0.25

    def __post_init__(self):
        if self.endpoint is not None and not str(self.endpoint).startswith(("http://", "https://")):
            raise ValueError("endpoint must be an HTTP address")
        positive(self.temperature, "temperature", zero=True)
        positive(self.tail_tolerance_sec, "tail_tolerance_sec", zero=True)
        positive(self.short_window_sec, "short_window_sec")
        if self.timeout_sec is not None:
            positive(self.timeout_sec, "timeout_sec")
        if min(self.max_completion_tokens, self.short_window_tokens) < 1:
            raise ValueError("token limits must be positive")


@dataclass(frozen=True)
class Embedding:
    chunk_sec: float = 1.5
    step_sec: float = 0.75
    dimension: int = 192
    batch_size: int = 64

    def __post_init__(self):
        positive(self.chunk_sec, "chunk_sec")
        positive(self.step_sec, "step_sec")
        if self.step_sec > self.chunk_sec or self.dimension < 2 or self.batch_size < 1:
            raise ValueError("embedding sizes out of range")


@dataclass(frozen=True)
class Association:
    policy: str = "identity"
    min_cosine: float = 0.70
    merge_cosine: float = 0.90
    split_cosine: float = 0.30
    core_min_sec: float = 1.5
    core_min_quality: float = 0.25
    best_effort_ticks: int = 1
    calibration: bool = False
    calibration_gain: float = 0.05
    calibration_cosine: float = 0.50
    identity: Settings = field(default_factory=Settings)

    def __post_init__(self):
        if self.policy not in POLICIES:
            raise ValueError(f"policy must be one of {POLICIES}")
        if not -1 <= self.split_cosine <= self.min_cosine <= self.merge_cosine <= 1:
            raise ValueError("split, least and merge cosine must be in order")
        for name in ("core_min_sec", "calibration_gain"):
            positive(getattr(self, name), name, zero=True)
        if not 0 <= self.core_min_quality <= 1 or self.best_effort_ticks < 0 or not isinstance(self.calibration, bool):
            raise ValueError("association settings out of range")


@dataclass(frozen=True)
class Config:
    audio_name: str = ""
    audio_path: str = ""
    duration_sec: float | None = None
    stream: Stream = field(default_factory=Stream)
    inference: Inference = field(default_factory=Inference)
    embedding: Embedding = field(default_factory=Embedding)
    association: Association = field(default_factory=Association)

    def checked(self, probed: float | None) -> Config:
        """self, if the declared duration is about that of the file: windows come from it, and a stale one would cut the recording short."""
        gap = 0.0 if self.duration_sec is None or probed is None else abs(self.duration_sec - probed)
        if gap > max(MISMATCH_SEC, MISMATCH_SHARE * (probed or 0.0)):
            raise ValueError(f"duration_sec is {self.duration_sec} and the file's {probed}")
        return self

    @property
    def timeout_sec(self) -> float:
        """Seconds that a request may take: its own setting, else the latency gate, else ten minutes."""
        return self.inference.timeout_sec or self.stream.max_wall_latency_sec or 600.0


BLOCKS = {"stream": Stream, "inference": Inference, "embedding": Embedding, "association": Association}


def _made(kind: type, given: Any, where: str) -> Any:
    if not isinstance(given, Mapping):
        raise ValueError(f"{where} must be an object")
    known = {f.name for f in fields(kind)}
    if old := sorted(set(given) & RETIRED - known):
        raise ValueError(f"{where}: no longer a setting: {', '.join(old)}")
    if odd := sorted(set(given) - known):
        raise ValueError(f"{where}: unknown settings: {', '.join(odd)}")
    values = {k: _made(Settings, v, f"{where}.{k}") if kind is Association and k == "identity" else v for k, v in given.items()}
    try:
        return kind(**values)
    except TypeError as e:
        raise ValueError(f"{where}: {e}") from e


def parse(given: Any) -> Config:
    if not isinstance(given, Mapping):
        raise ValueError("settings must be a JSON object")
    sample = given.get("sample", {})
    if not isinstance(sample, Mapping) or (odd := sorted(set(given) - {"sample", *BLOCKS})):
        raise ValueError(f"unknown blocks: {', '.join(odd) if isinstance(sample, Mapping) else 'sample'}")
    blocks = {k: _made(kind, given.get(k, {}), k) for k, kind in BLOCKS.items()}
    length = sample.get("duration_sec")
    return Config(str(sample.get("audio_name", "")), str(sample.get("audio_path", "")), None if length is None else positive(length, "duration_sec"), **blocks)


def load(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        return parse(json.load(f))
