"""A recording, tick by tick: windows are decoded, the ledger publishes, and each tick leaves a row of the trace.

The decoder, what gives lasting labels, observers and what runs after a tick are handed in. A tick commits, binds and publishes as one step. An observer sees copies and can't fail a run. A recoverable error of the
decoder gives an empty tick; any other ends the run, as does a run whose ticks all failed."""

from __future__ import annotations

import copy
import hashlib
import json
import time
from collections.abc import Callable, Iterable, Iterator

from ..config import Stream
from ..functions.decoder import Decoded, Decoder, Window, attempt
from ..functions.turns import Turn, normal
from .ledger import Ledger, Rules, stable_id


def schedule(duration: float, stream: Stream) -> Iterator[Window]:
    """Windows that end every step seconds, and one that ends with the recording; ticks are multiples of the step, so they do not drift."""
    k = 1
    while k * stream.step_sec < duration - 1e-9:
        yield Window(k * stream.step_sec, max(0.0, k * stream.step_sec - stream.context_sec), k * stream.step_sec)
        k += 1
    if duration > 0:
        yield Window(duration, max(0.0, duration - stream.context_sec), duration)


def digest(value) -> str:
    """Of a JSON value, whatever the order of its keys; what is not finite is an error."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False).encode("utf-8", "replace")).hexdigest()


def as_row(t: Turn) -> dict:
    return {"start": t.start, "end": t.end, "speaker": t.speaker, "text": t.text, "source_tick": t.tick}


class Engine:
    def __init__(self, decode: Decoder, stream: Stream | None = None, *, ledger: Ledger | None = None, prompt: str = "", map_turns: Callable[[Window, tuple[Turn, ...]], Iterable[Turn]] | None = None, bind: Callable[[list[Turn], Window], list[str]] | None = None, after: Callable[[list[Turn], Window], dict] | None = None, observers: Iterable[Callable[[dict], None]] = (), clock: Callable[[], float] = time.perf_counter):
        self.decode, self.stream, self.prompt, self.map_turns, self.bind, self.after, self.observers, self.clock = decode, stream or Stream(), prompt, map_turns, bind, after, list(observers), clock
        self.labels: dict[str, str] = {}
        self.ledger = ledger or Ledger(Rules(right=self.stream.right_context_sec, context=self.stream.context_sec, overlap_seconds=self.stream.overlap_sec_min, overlap_share=self.stream.overlap_fraction_min, grace=self.stream.empty_grace_ticks, deadline=self.stream.best_effort_publish_sec))
        self.rows: list[dict] = []
        self.published: list[Turn] = []
        self.profile: dict[str, float] = {}
        self.observer_errors, self.error, self.closed = 0, None, False

    def _timed(self, stage: str, call: Callable):
        began = self.clock()
        try:
            return call()
        finally:
            self.profile[stage] = self.profile.get(stage, 0.0) + self.clock() - began

    def tick(self, window: Window, final: bool = False) -> dict:
        if self.closed or (self.rows and window.tick <= self.rows[-1]["tick"]):
            raise ValueError("ticks follow one another, until the run ends")
        began = self.clock()
        got: Decoded = self._timed("decode", lambda: attempt(self.decode, window, self.prompt))
        mapped = tuple(self.map_turns(window, got.turns)) if self.map_turns else got.turns
        if odd := [t for t in mapped if t.start < window.start - 1e-3 or t.end > window.end + 1e-3]:
            raise ValueError(f"a turn lies outside its window: {odd[0]}")
        new = self._timed("commit", lambda: self.ledger.take(window.tick, list(mapped), final))
        if self.bind:
            new = [self._named(t, label) for t, label in zip(new, self._timed("bind", lambda: self.bind(new, window)), strict=True)]
        self.published += new
        row = {
            "tick": window.tick, "window_start": window.start, "window_end": window.end, "status": "passed", "gate_status": "passed", "text": got.text,
            "local_segments": [as_row(t) for t in got.turns], "mapped_segments": [as_row(t) for t in mapped], "delta_segments": [as_row(t) for t in new], "committed_segments": [as_row(t) for t in new],
            "user_text_delta": "".join(t.text for t in new), "pending_segments": [as_row(h.turn) for h in self.ledger.pending], "stable_until": self.ledger.stable, "published_until": self.ledger.until,
            "pending_age_sec": max((window.tick - h.first for h in self.ledger.pending), default=0.0), "delta_first_publish_age_sec": max((window.tick - t.end for t in new), default=0.0),
            "elapsed_sec": got.seconds, "dropped": [list(x) for x in got.dropped], "error": got.error,
        }
        for name, value in (self.after(new, window) if self.after else {}).items():
            if name in row:
                raise ValueError(f"{name} is a field of the trace already")
            row[name] = value
        row["wall_elapsed_sec"] = self.clock() - began
        self.rows.append(row)
        for see in self.observers:
            try:
                see(copy.deepcopy(row))
            except Exception:  # an observer may not end a run
                self.observer_errors += 1
        return row

    def _named(self, t: Turn, label: str) -> Turn:
        """The turn under its lasting label, which is given once."""
        key = stable_id(t)
        if self.labels.setdefault(key, label) != label:
            raise ValueError(f"a label would be rewritten: {self.labels[key]} to {label}")
        return t._replace(speaker=label)

    def run(self, duration: float) -> dict:
        """All ticks of a recording, and its validation."""
        windows = list(schedule(duration, self.stream))
        try:
            for w in windows:
                self.tick(w, w is windows[-1])
        except Exception as e:
            self.fail(e)
            raise
        return self.finish(len(windows))

    def fail(self, error: Exception) -> None:
        self.error, self.closed = repr(error)[:512], True

    def finish(self, expected: int) -> dict:
        self.closed = True
        return self.validation(expected)

    def validation(self, expected: int) -> dict:
        """What the run observed and published, and its gates."""
        errors = [r["tick"] for r in self.rows if r["error"]]
        ids = [stable_id(t) for t in self.published]
        mapped = sum(len(r["mapped_segments"]) for r in self.rows)
        material = sum(bool(normal(t["text"])) for r in self.rows for t in r["mapped_segments"])
        worst, limit = max((r["wall_elapsed_sec"] for r in self.rows), default=0.0), self.stream.max_wall_latency_sec
        out = {
            "tick_count": len(self.rows), "expected_tick_count": expected, "failed_ticks": [], "recoverable_decode_error_ticks": errors, "recoverable_decode_error_count": len(errors), "recoverable_decode_error_gate_pass": len(errors) < max(1, expected),
            "latency": {"source": "wall_elapsed_sec", "max_sec": worst, "count": len(self.rows)}, "wall_latency_gate_sec": limit, "wall_latency_gate_pass": None if limit is None else worst <= limit + 1e-9, "algorithmic_delay_sec": self.stream.delay_sec,
            "pending_age_max_sec": max((r["pending_age_sec"] for r in self.rows), default=0.0), "delta_first_publish_age_max_sec": max((r["delta_first_publish_age_sec"] for r in self.rows), default=0.0),
            "trace_gate_pass": len(ids) == len(set(ids)) and all(r["delta_first_publish_age_sec"] >= 0 for r in self.rows), "timestamp_violations": [], "schedule_mismatches": [],
            "observed_speech": mapped > 0, "observed_material_content": material > 0, "observed_mapped_segment_count": mapped, "committed_segment_count": len(self.published), "final_content_gate_pass": not material or bool(self.published),
            "dropped": dict(self.ledger.dropped), "observer_errors": self.observer_errors, "error": self.error,
        }
        out["execution_gate_pass"] = self.error is None and len(self.rows) == expected and out["recoverable_decode_error_gate_pass"] and out["wall_latency_gate_pass"] is not False
        out["status"] = "passed" if out["execution_gate_pass"] and out["trace_gate_pass"] and out["final_content_gate_pass"] else "failed"
        return out
